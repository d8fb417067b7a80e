"""Published results as goldens: the seven confusion matrices of the
restaurant-review run and the event-extraction counts."""

import math

import pytest
from pyspark.sql import functions as F

from promptloom.operators.absa import SENTIMENTS, class_scores
from promptloom.operators.metrics import micro_prf

# Published matrices (rows = label, cols = prediction, class order 正面 中性 负面 未提及),
# their accuracy and kappa.
GOLDEN = {
    "ALL": ([[92, 1, 2, 5], [12, 3, 4, 3], [5, 0, 7, 3], [4, 0, 1, 158]], 0.8667, 0.7639),
    "食品评价": ([[36, 0, 0, 0], [6, 3, 1, 0], [2, 0, 2, 0], [0, 0, 0, 0]], 0.82, 0.5682),
    "饮品评价": ([[12, 0, 0, 0], [3, 0, 0, 0], [1, 0, 0, 1], [2, 0, 0, 31]], 0.86, 0.7123),
    "价格水平": ([[17, 1, 1, 0], [3, 0, 0, 0], [0, 0, 2, 2], [0, 0, 0, 24]], 0.86, 0.7763),
    "卫生情况": ([[6, 0, 0, 3], [0, 0, 0, 1], [0, 0, 0, 0], [1, 0, 0, 39]], 0.9, 0.6671),
    "服务人员态度": ([[19, 0, 1, 2], [0, 0, 3, 1], [2, 0, 3, 0], [1, 0, 1, 17]], 0.78, 0.6516),
    "停车方便程度": ([[2, 0, 0, 0], [0, 0, 0, 1], [0, 0, 0, 0], [0, 0, 0, 47]], 0.98, 0.852),
}
ALL_PRECISION = [0.8142, 0.75, 0.5, 0.9349]
ALL_RECALL = [0.92, 0.1364, 0.4667, 0.9693]


@pytest.fixture(scope="module")
def scores(spark):
    rows = [("run", a, SENTIMENTS[i], SENTIMENTS[j], int(m[i][j]))
            for a, (m, _, _) in GOLDEN.items() for i in range(4) for j in range(4)]
    mat = spark.createDataFrame(rows, "mode string, aspect string, label string, pred string, n long")
    return {(r.aspect, r.cls): r for r in class_scores(mat, ["mode"]).collect()}


def test_kappa_matches_published(scores):
    for a, (_, _, kappa) in GOLDEN.items():
        assert scores[(a, "正面")].kappa == pytest.approx(kappa, abs=1e-9), a


def test_precision_recall_all(scores):
    for i, c in enumerate(SENTIMENTS):
        assert scores[("ALL", c)].precision == pytest.approx(ALL_PRECISION[i])
        assert scores[("ALL", c)].recall == pytest.approx(ALL_RECALL[i])


def test_zero_denominator_is_nan(scores):
    # 饮品评价 has no 中性 predictions: precision undefined
    assert math.isnan(scores[("饮品评价", "中性")].precision)
    # 卫生情况 has no 负面 labels and no 负面 predictions
    assert math.isnan(scores[("卫生情况", "负面")].recall)


def test_accuracy_from_matrices():
    for a, (m, acc, _) in GOLDEN.items():
        assert round(sum(m[i][i] for i in range(4)) / sum(map(sum, m)), 4) == acc


def test_event_prf(spark):
    df = spark.createDataFrame([(67, 35, 80)], "tp long, fp long, fn long")
    r = micro_prf(df, [], scale=7).first()
    assert (r.precision, r.recall, r.f1) == (0.6568627, 0.4557823, 0.5381526)
