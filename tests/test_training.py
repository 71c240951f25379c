"""Mini-batch training against plain numpy, and after a restart."""

import numpy as np
import pytest
from compare import DATA
from pyspark.sql import functions as F

from tessera.operators import training
from tessera.plans import chips, history

SF = str(DATA / "sf0.001")
SETTINGS = training.Settings(epochs=3, batch=80, seed=5)


def by_hand(rows, val, settings, batch_of):
    """The same training over arrays, one pixel's loss at a time where it is not a sum."""
    state = training.start(settings)
    w, m, v, step, out, best = state.weights, 0 * state.weights, 0 * state.weights, 0, [], -1.0
    n = max(1, -(-len(rows) // settings.batch))
    for epoch in range(1, settings.epochs + 1):
        losses = []
        for b in range(n):
            own = [r for k, r in rows.items() if batch_of[epoch][k] == b]
            if not own:
                continue
            p, t, ok = (np.array([r[i] for r in own], float) for i in range(3))
            x = training.patches(p, chips.SIDE)

            def loss(w, x=x, t=t, ok=ok):
                share = training.forward(w, x)[1]
                return (-np.log(np.where(t.ravel() == 1, share[:, 1], share[:, 0])) * ok.ravel()).sum() / ok.sum()

            g = training.gradient(w, p, t, ok, chips.SIDE)
            if epoch == 1 and b == 0:
                for k in range(0, len(w), 7):  # the gradient against differences
                    step_k = np.zeros(len(w))
                    step_k[k] = 1e-6
                    assert g[k] / ok.sum() == pytest.approx((loss(w + step_k) - loss(w - step_k)) / 2e-6, abs=1e-6)
            losses.append(loss(w))
            step += 1
            g = g[:-2] / ok.sum()
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - settings.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        ious, f1s = [], []
        for p, t, ok in val.values():
            y = training.forward(w, training.patches(np.array([p]), chips.SIDE))[1][:, 1] > 0.5
            t, ok = np.array(t) == 1, np.array(ok) == 1
            tp, fp, fn = (t & y & ok).sum(), (~t & y & ok).sum(), (t & ~y & ok).sum()
            ious.append(1.0 if tp + fp + fn == 0 else tp / (tp + fp + fn))
            f1s.append(1.0 if tp + fp + fn == 0 else 2 * tp / (2 * tp + fp + fn))
        out.append((epoch, np.mean(losses), np.mean(ious), np.mean(f1s)))
    return w, out


@pytest.fixture(scope="module")
def data(spark):
    chip = chips.chips(spark, SF).select("vec_id", "px").where("vec_id < 400").cache()
    split = {r["vec_id"]: ([x["p"] for x in r["px"]], [x["target"] for x in r["px"]], [x["valid"] for x in r["px"]]) for r in chip.collect()}
    return chip, split


def test_training_equals_plain_numpy_and_goes_on_after_a_stop(spark, data, tmp_path):
    chip, split = data
    even, odd = chip.where("vec_id % 2 = 0"), chip.where("vec_id % 2 = 1")
    rows = {k: x for k, x in split.items() if k % 2 == 0}
    n = -(-len(rows) // SETTINGS.batch)
    batch_of = {e: {r["vec_id"]: r["b"] for r in even.select("vec_id", F.pmod(F.xxhash64("vec_id", F.lit(5), F.lit(e)), F.lit(n)).alias("b")).collect()} for e in (1, 2, 3)}
    w, want = by_hand(rows, {k: x for k, x in split.items() if k % 2}, SETTINGS, batch_of)
    whole = training.train(even, odd, chips.SIDE, str(tmp_path / "a"), SETTINGS)
    assert np.allclose(whole.weights, w, atol=1e-9)
    assert [(h["epoch"], pytest.approx(h["train_loss_mean"]), pytest.approx(h["val_iou"]), pytest.approx(h["val_f1"])) for h in whole.history] == want
    assert want[-1][1] < want[0][1]
    training.train(even, odd, chips.SIDE, str(tmp_path / "b"), training.Settings(epochs=1, batch=80, seed=5))
    again = training.train(even, odd, chips.SIDE, str(tmp_path / "b"), SETTINGS)
    assert np.allclose(again.weights, whole.weights, atol=1e-12) and again.best == whole.best and np.allclose(again.best_weights, whole.best_weights, atol=1e-12)
    best = max(want, key=lambda h: (h[2], -h[0]))
    assert whole.best["epoch"] == best[0] and whole.best["val_iou"] == pytest.approx(best[2])
    kept = training.load(spark, str(tmp_path / "a"))
    assert len(kept.history) == 3 and training.load(spark, str(tmp_path / "none")) is None


def test_training_without_chips_or_validation(spark, data, tmp_path):
    chip, _ = data
    none = training.train(chip.limit(0), None, chips.SIDE, str(tmp_path / "none"), training.Settings(epochs=1))
    assert np.isnan(none.history[0]["train_loss_mean"]) and none.best["epoch"] == 1 and none.step == 0
    blind = chip.limit(4).withColumn("px", F.transform("px", lambda x: F.struct(x["i"].alias("i"), x["p"].alias("p"), x["target"].alias("target"), F.lit(0).alias("valid"))))
    assert training.train(blind, None, chips.SIDE, str(tmp_path / "blind"), training.Settings(epochs=1)).step == 0


def test_history_query_tells_each_epoch(spark):
    rows = history.training_history(spark, SF).orderBy("epoch").collect()
    assert [r["epoch"] for r in rows] == [1, 2, 3] and sum(r["best"] for r in rows) == 1
    assert all(r["line"].startswith(f"epoch   {r['epoch']}: loss={r['train_loss_mean']:.4f} val_iou=0.") for r in rows)
