"""Queries on feature preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskframe.operators import prep
from riskframe.plans import encounters as enc
from riskframe.plans.catalog_data import ENC_COLUMNS
from riskframe.plans.standins import digest_number_sql, rounded, sql, view
from riskframe.operators.split import hash_split
from riskframe.session import materialize

QUERIES: dict = {}
ORACLES: dict = {}

WIDE_NUMERIC = ["total", "quantity", "discount", "n_lines"]
WIDE_CATEGORICAL = ["priority", "segment_id"]
DOC_CATEGORICAL = ["lang", "origin"]
FEATURES = [c for c in ENC_COLUMNS if c not in ("encounter_id", "patient_nbr", "readmitted")]


def constant_sql(c: str) -> str:
    return (
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) + (CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END) <= 1 "
        "AS is_constant FROM enc"
    )


QUERIES["feature_constant"] = lambda spark, d: prep.constant_columns(view(spark, d, "enc"), FEATURES)
ORACLES["feature_constant"] = sql(" UNION ALL ".join(constant_sql(c) for c in FEATURES), "enc")
QUERIES["feature_spec"] = lambda spark, d: prep.feature_roles(
    view(spark, d, "enc"), "readmitted", enc.NUMERIC_COLUMNS, [enc.KEY, enc.GROUP]
)
ORACLES["feature_spec"] = sql(
    " UNION ALL ".join(
        f"SELECT column_name, CAST({i + 1} AS INT) AS place, CASE WHEN is_constant THEN 'constant' "
        f"ELSE '{'numeric' if c in enc.NUMERIC_COLUMNS else 'categorical'}' END AS role FROM ({constant_sql(c)})"
        for i, c in enumerate(FEATURES)
    ),
    "enc",
)


def impute_median(spark, d) -> DataFrame:
    wide = materialize(view(spark, d, "wide").select("o_orderkey", *WIDE_NUMERIC), "wide")
    stats = prep.numeric_stats(wide, WIDE_NUMERIC)["all"]
    return rounded(
        wide.select(
            "o_orderkey", *[F.coalesce(F.col(c).cast("double"), F.lit(stats[c].median)).alias(c) for c in WIDE_NUMERIC]
        )
    )


FILLED = ", ".join(
    f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM wide)) AS {c}" for c in WIDE_NUMERIC
)
QUERIES["impute_median"] = impute_median
ORACLES["impute_median"] = sql(
    f"WITH filled AS (SELECT o_orderkey, {FILLED} FROM wide) SELECT o_orderkey, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in WIDE_NUMERIC)
    + " FROM filled",
    "wide",
)


def scale_standard(spark, d) -> DataFrame:
    wide = materialize(view(spark, d, "wide").select("o_orderkey", *WIDE_NUMERIC), "wide")
    return rounded(prep.impute_and_scale(wide, prep.numeric_stats(wide, WIDE_NUMERIC)["all"]))


QUERIES["scale_standard"] = scale_standard
ORACLES["scale_standard"] = sql(
    f"WITH filled AS (SELECT o_orderkey, {FILLED} FROM wide) SELECT o_orderkey, "
    + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}" for c in WIDE_NUMERIC)
    + " FROM filled",
    "wide",
)
QUERIES["impute_missing_cat"] = lambda spark, d: view(spark, d, "wide").select(
    "o_orderkey", *[prep.as_level(c).alias(c) for c in WIDE_CATEGORICAL]
)
ORACLES["impute_missing_cat"] = sql(
    "SELECT o_orderkey, "
    + ", ".join(f"coalesce(CAST({c} AS VARCHAR), 'Missing') AS {c}" for c in WIDE_CATEGORICAL)
    + " FROM wide",
    "wide",
)


def vocabulary_sql(source: str, columns=DOC_CATEGORICAL) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, coalesce(CAST({c} AS VARCHAR), 'Missing') AS level, count(*) AS n,
        concat('{c}_', CASE WHEN count(*) >= 10 THEN coalesce(CAST({c} AS VARCHAR), 'Missing') ELSE 'infrequent' END) AS slot
        FROM {source} GROUP BY 2"""
        for c in columns
    )


# The vocabulary is learned on part of the documents, so that others hold unseen levels.
TRAIN_DOCS = "shard < 20"
QUERIES["onehot_vocab"] = lambda spark, d: prep.onehot_vocabulary(view(spark, d, "docs"), DOC_CATEGORICAL)
ORACLES["onehot_vocab"] = sql(vocabulary_sql("docs"), "docs")


def onehot_long(spark, d) -> DataFrame:
    docs = view(spark, d, "docs")
    vocabulary = materialize(prep.onehot_vocabulary(docs.where(TRAIN_DOCS), DOC_CATEGORICAL), "vocabulary")
    return prep.onehot_long(docs, "doc_id", DOC_CATEGORICAL, vocabulary)


ONEHOT_SQL = (
    f"WITH train AS (SELECT * FROM docs WHERE {TRAIN_DOCS}), vocab AS ({vocabulary_sql('train')}), cells AS ("
    + " UNION ALL ".join(
        f"SELECT doc_id, '{c}' AS column_name, coalesce({c}, 'Missing') AS level FROM docs" for c in DOC_CATEGORICAL
    )
    + ") SELECT doc_id, slot AS feature, CAST(1.0 AS DOUBLE) AS value FROM cells JOIN vocab USING (column_name, level)"
)
QUERIES["onehot_long"] = onehot_long
ORACLES["onehot_long"] = sql(ONEHOT_SQL, "docs")


def docs_encoder(spark, d):
    docs = view(spark, d, "docs")
    spec = prep.FeatureSpec(["n_chars"], DOC_CATEGORICAL)
    stats = prep.fit_stats(docs.where(TRAIN_DOCS), spec)["all"]
    return docs, prep.encoder(spark, spec, stats), prep.feature_names(spec, stats)


def encoded_long(spark, d) -> DataFrame:
    """Non-zero entries of the encoded vectors, by name."""
    docs, model, names = docs_encoder(spark, d)
    _, indices, values = prep.sparse_parts()
    cells = F.explode(F.arrays_zip(indices.alias("i"), values.alias("v")))
    labels = F.array(*[F.lit(n) for n in names])
    out = model.transform(docs).select("doc_id", cells.alias("c")).where("c.v <> 0")
    return rounded(out.select("doc_id", labels[F.col("c.i")].alias("feature"), F.col("c.v").alias("value")))


QUERIES["encoded_long"] = encoded_long
ORACLES["encoded_long"] = sql(
    ONEHOT_SQL
    + """ UNION ALL SELECT doc_id, 'n_chars' AS feature, round(
        (n_chars - (SELECT avg(n_chars) FROM train)) / (SELECT stddev_pop(n_chars) FROM train), 6) AS value FROM docs""",
    "docs",
)


def encoded_check(spark, d) -> DataFrame:
    docs, model, _ = docs_encoder(spark, d)
    return prep.encoded_check(model, {"train": docs.where(TRAIN_DOCS), "test": docs.where(f"NOT ({TRAIN_DOCS})")})


QUERIES["encoded_check"] = encoded_check
ORACLES["encoded_check"] = sql(
    f"""WITH train AS (SELECT * FROM docs WHERE {TRAIN_DOCS}), vocab AS ({vocabulary_sql('train')}),
    width AS (SELECT CAST(1 + count(DISTINCT slot) AS INT) AS w FROM vocab)
    SELECT CASE WHEN {TRAIN_DOCS} THEN 'train' ELSE 'test' END AS side, count(*) AS n_rows,
           max(w) AS min_width, max(w) AS max_width, CAST(0 AS BIGINT) AS n_nan
    FROM docs, width GROUP BY 1""",
    "docs",
)


def fold_stats(spark, d) -> DataFrame:
    tagged = materialize(hash_split(view(spark, d, "wide"), "o_custkey", 5).select("fold", *WIDE_NUMERIC), "tagged")
    return rounded(prep.fold_stats(tagged, "fold", 5, WIDE_NUMERIC))


QUERIES["fold_stats"] = fold_stats
ORACLES["fold_stats"] = sql(
    f"WITH tagged AS (SELECT *, {digest_number_sql(42, 'o_custkey')} % 5 AS f FROM wide), "
    + "long AS ("
    + " UNION ALL ".join(
        f"SELECT k AS fold, '{c}' AS column_name, {c} AS v FROM tagged, range(5) AS r(k) WHERE f <> k"
        for c in WIDE_NUMERIC
    )
    + """), med AS (SELECT fold, column_name, quantile_cont(v, 0.5) AS median FROM long GROUP BY ALL)
    SELECT CAST(fold AS INT) AS fold, column_name, round(max(median), 6) AS median,
           round(avg(coalesce(v, median)), 6) AS mean, round(stddev_pop(coalesce(v, median)), 6) AS std
    FROM long JOIN med USING (fold, column_name) GROUP BY fold, column_name""",
    "wide",
)
