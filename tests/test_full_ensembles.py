"""Registered fits use the library's default sizes."""

import pytest

from radiolens.catalog import CHECKS
from radiolens.operators import train


class Asked(Exception):
    pass


@pytest.mark.parametrize(("name", "fit"), [
    ("train_coverage", "train_coverage"), ("score", "train_coverage_forest"), ("feature_importance", "train_coverage_forest"),
    ("stream_score", "train_coverage_forest"), ("train_umts_tasks", "train_umts_tasks"),
    ("train_handover_tasks", "train_handover_tasks"), ("cross_validate", "handover_models"),
])
def test_registered_fits_use_the_default_sizes(tables, monkeypatch, name, fit):
    def asked(*args, sizes=train.TreeSizes(), **kwargs):
        given = [x for x in args if isinstance(x, train.TreeSizes)]
        raise Asked(given[0] if given else sizes)

    monkeypatch.setattr(train, fit, asked)
    with pytest.raises(Asked) as found:
        CHECKS[name].run(tables)
    assert found.value.args[0] == train.TreeSizes()
