"""The model queries call their operators with the whole job: all categories, ten starts, and defaults but for gates."""

import pytest

import __spark_entry__ as entry
from opinara.operators import clustering, models


class Seen(Exception):
    pass


SETTINGS = {
    "m4_global_clusters": (clustering, "fit_global", {"seeds": 10}),
    "m5_inertia_sweep": (clustering, "inertia_sweep", {"seeds": 10}),
    "m6_category_clusters": (clustering, "fit_per_category", {"seeds": 10, "gate": 1}),
    "m10_calibrated_svc": (models, "calibrated_svc", {}),
    "m11_boosted_trees": (models, "boosted_trees", {}),
    "m17_upweight_sweep": (models, "upweight_sweep", {}),
    "m21_quality_vs_quantity": (models, "quality_vs_quantity", {"sizes": 2}),
    "m21_category_curves": (models, "category_curves", {"minimum": 3}),
}


@pytest.mark.parametrize("name", SETTINGS)
def test_operators_run_at_their_defaults(spark, folder, monkeypatch, name):
    module, operator, given = SETTINGS[name]

    def spy(*args, **settings):
        raise Seen(args, settings)

    monkeypatch.setattr(module, operator, spy)
    with pytest.raises(Seen) as seen:
        entry.queries()[name](spark, folder)
    args, settings = seen.value.args
    assert {k: len(v) if isinstance(v, (tuple, list)) else 1 for k, v in settings.items()} == given
    if operator == "category_curves":
        assert sorted(args[2]) == sorted(r.category for r in args[0].select("category").distinct().collect())


def test_all_models_are_compared(spark, folder, monkeypatch):
    names = ["logistic", "perceptron", "calibrated_svc", "boosted_trees"]
    for name in names:
        monkeypatch.setattr(models, name, lambda train, **settings: settings)

    def compared(fitted, test):
        raise Seen(fitted)

    monkeypatch.setattr(models, "compare_models", compared)
    with pytest.raises(Seen) as seen:
        entry.queries()["m20_model_comparison"](spark, folder)
    assert seen.value.args == (dict.fromkeys(names, {}),)
