import json
import math

from kinloom.plans.cache import RunLog, cached, finite, parameter_key


def test_tables_are_built_once_per_parameters(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    a = cached(spark, str(tmp_path), "t", {"k": 1}, build)
    b = cached(spark, str(tmp_path), "t", {"k": 1}, build)
    c = cached(spark, str(tmp_path), "t", {"k": 2}, build)
    assert len(built) == 2 and a.count() == b.count() == c.count() == 3
    assert parameter_key("t", {"a": 1, "b": 2}) == parameter_key("t", {"b": 2, "a": 1})


def test_log_has_no_nan(tmp_path):
    log = RunLog(str(tmp_path))
    log.log(loss=math.nan, step=1)
    log.log(loss=0.5, step=2)
    log.summary(best=math.inf, folds=[1.0, math.nan])
    lines = [json.loads(x) for x in (tmp_path / "metrics.jsonl").read_text().splitlines()]
    assert lines == [{"loss": None, "step": 1}, {"loss": 0.5, "step": 2}]
    assert json.loads((tmp_path / "summary.json").read_text()) == {"best": None, "folds": [1.0, None]}
    assert finite({"x": (1, -math.inf)}) == {"x": [1, None]}
