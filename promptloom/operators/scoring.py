"""Batch scoring with a caller-supplied model.

``batch_predict`` runs the caller's function on Arrow batches inside the
executors (``mapInPandas``): the model is loaded once per task by the factory,
rows keep every carried column (no positional re-join), a failing call is
retried row by row and a failing row yields '' plus an error message.
Everything after the model call is built-in column arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptloom.functions.columns import neg_log_sigmoid, sigmoid
from promptloom.operators.order import with_global_index
from promptloom.session import materialize


#: Calls whose outputs a task holds before it hands them on.
CALLS_OUT = 16


def batch_predict(df: DataFrame, prompt_col: str, make_predict: Callable[[], Callable],
                  batch_size: int = 16, out_col: str = "prediction", error_col: str = "error") -> DataFrame:
    """Predictions for every row; ``make_predict()`` returns a
    function taking a str or a list of str and returning str / list of str."""
    schema = T.StructType(list(df.schema.fields) + [T.StructField(out_col, T.StringType()),
                                                     T.StructField(error_col, T.StringType())])

    def run(batches):
        predict = make_predict()

        def call(prompts):
            out = predict(prompts)
            return [out] if isinstance(out, str) else list(out)

        for pdf in batches:
            for start in range(0, len(pdf), batch_size * CALLS_OUT):  # outputs leave a few calls at a time
                some = pdf.iloc[start:start + batch_size * CALLS_OUT].copy()
                preds, errs = [], []
                prompts = some[prompt_col].tolist()
                for s in range(0, len(prompts), batch_size):
                    chunk = prompts[s:s + batch_size]
                    try:
                        res = call(chunk)
                        if len(res) != len(chunk):
                            raise ValueError("prediction count differs from prompt count")
                        preds += res
                        errs += [""] * len(chunk)
                    except Exception:  # noqa: BLE001 - isolate the failing rows
                        for p in chunk:
                            try:
                                preds.append(call(p)[0])
                                errs.append("")
                            except Exception as e:  # noqa: BLE001
                                preds.append("")
                                errs.append(type(e).__name__)
                some[out_col] = preds
                some[error_col] = errs
                yield some

    return df.mapInPandas(run, schema)


def needs_retry(prediction: Column) -> Column:
    """I5 on a row of the output: no non-empty result."""
    return F.coalesce(prediction == "", F.lit(True))


def retry_set(inputs: DataFrame, outputs: DataFrame, key: str, out_col: str = "prediction") -> DataFrame:
    """Inputs without a non-empty result (left anti join on the key)."""
    done = outputs.filter(F.col(out_col) != "").select(key)
    return inputs.join(done, key, "left_anti")


def reward(logit: Column) -> Column:
    """Sigmoid of the reward model's logit."""
    return sigmoid(logit)


def reward_accuracy(rj: Column, rk: Column) -> Column:
    """Share of pairs with r_j >= r_k (a tie counts as correct)."""
    return F.avg((rj >= rk).cast("double"))


def pairwise_loss(rj: Column, rk: Column) -> Column:
    """Mean -log(sigmoid(r_j - r_k)), overflow-safe."""
    return F.avg(neg_log_sigmoid(rj - rk))


def run_monitor(rollouts: DataFrame, step_col: str, score_col: str, response_col: str,
                window: int = 10, collapse_score: float = 0.0) -> DataFrame:
    """Per step mean score, mean response length, collapse alerts (empty
    response with score above ``collapse_score``) and a moving average of the
    mean score over the last ``window`` steps: each step adds its score to the
    averages of itself and the next ``window - 1`` positions (no global window)."""
    per = rollouts.groupBy(step_col).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score_col).alias("mean_score"),
        F.avg(F.length(response_col)).alias("mean_len"),
        F.count_if((F.length(response_col) == 0) & (F.col(score_col) > collapse_score)).alias("n_alert"))
    per = materialize(with_global_index(per, [step_col], "_at"))
    reach = F.sequence(F.col("_at"), F.col("_at") + (window - 1))
    ma = per.select(F.explode(reach).alias("_at"), "mean_score").groupBy("_at").agg(F.avg("mean_score").alias("ma_score"))
    return per.join(ma, "_at").drop("_at")
