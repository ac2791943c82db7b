"""Small tables with the awkward cases: missing values, empty and long texts, repeats, clashing names."""

import zlib

DOCS = "doc_id long, text string, lang string, source string, n_chars long, "
CLASHING = "score double, code string, number string, c0 int, k0 int, i0 int, r0 int, shard int, w int, words string"

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def sentence(seed: int, n: int) -> str:
    """Words that look alike for no two seeds."""
    out, state = [], seed * 7919 + 13
    for _ in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(state >> 8) % len(WORDS)] + (str(state % 7) if state % 3 == 0 else ""))
    return " ".join(out)


LONG = sentence(99, 12_000)
TEXTS = [
    sentence(1, 40),
    sentence(1, 40),  # an exact copy
    sentence(2, 300),
    sentence(2, 299) + " changed",
    sentence(3, 30).upper(),
    "",
    None,
    "   \n\t ",
    "one",
    "two words",
    LONG,
    LONG,
    "Ünïcödé straße élève naïve 123 'tis <|endoftext|> it's — … 日本語テキスト",
    "marks, only!! ### $$$ 4026083977531332",
    "A B C D\x0bE\x0cF",
]


def doc_rows():
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else f"src{i}", None if i == 4 else len(t or "")) for i, t in enumerate(TEXTS)]
    rows.append(rows[2])  # a repeated row
    rows.append((None, sentence(5, 20), "en", None, None))  # no id
    rows.append((None, None, None, None, None))
    return [(*r, 0.5, "x", "y", 1, 2, 3, 4, 5, 6, "z") for r in rows]


def documents(spark, rows=None):
    return spark.createDataFrame(doc_rows() if rows is None else rows, DOCS + CLASHING)


def plain(spark, texts):
    """(doc_id, text) of the given texts."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def fold(doc_id, remainder):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == remainder
