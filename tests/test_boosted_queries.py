import pytest

from riskframe.operators import model
from riskframe.plans import catalog, catalog_model


@pytest.mark.parametrize("name", ["gbt_score", "attrib_tree", "attrib_tree_gap", "attrib_tree_global"])
def test_queries_train_the_tuned_trees(spark, monkeypatch, name):
    class Asked(Exception):
        pass

    def learner(params=None, **_):
        raise Asked(params)

    monkeypatch.setattr(model, "boosted_learner", learner)
    monkeypatch.setattr(catalog_model, "FITTED", {})
    with pytest.raises(Asked) as asked:
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert asked.value.args[0] == model.TUNED_BOOST
