import numpy as np
import pytest

from strandloom.plans import training

FLANK, REACH = 4, 2
SCHEMA = "seq_id string, strand int, win_idx int, seq string, ann array<short>, weight array<short>, transition array<short>, transition_mask array<short>, phase array<short>"


def windows(n, seed, size=50):
    """Windows of which the class follows from a base and its neighbours; a fifth of the bases has no weight."""
    r = np.random.default_rng(seed)
    out = []
    for k in range(n):
        seq = "".join(r.choice(list("ACGTN"), size + 2 * FLANK, p=[0.24, 0.24, 0.24, 0.24, 0.04]))
        core = seq[FLANK : FLANK + size]
        ann = [2 if a in "CG" and b in "CG" else 1 if a == "T" else 0 for a, b in zip(core, seq[FLANK + 1 :])]
        weight = (r.random(size) < 0.8).astype(int) * 2
        step = [int(a != b) for a, b in zip(ann, ann[1:] + [0])]
        out.append((f"s{k}", 1, k, seq, ann, weight.tolist(), step, (weight > 0).astype(int).tolist(), [3 if a != 2 else i % 3 for i, a in enumerate(ann)]))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(windows(40, 1), SCHEMA).repartition(3), spark.createDataFrame(windows(10, 2), SCHEMA)


def dense(rows, weights, tasks=training.TASKS):
    """Loss and gradient with a whole feature matrix, one base at a time."""
    gradient, loss, n = np.zeros_like(weights), 0.0, 0
    for _, _, _, seq, ann, weight, step, mask, phase in rows:
        tracks = {"ann": ann, "weight": weight, "transition": step, "transition_mask": mask, "phase": phase}
        for t in range(len(ann)):
            x = np.zeros(len(weights))
            x[-1] = 1
            for k in range(2 * REACH + 1):
                c = seq[FLANK + t - REACH + k]
                x[4 * k : 4 * k + 4] = 0.25 if c == "N" else [c == b for b in "ACGT"]
            at = 0
            for task in tasks:
                z = x @ weights[:, at : at + task.classes]
                p = np.exp(z) / np.exp(z).sum()
                w = tracks[task.weight][t] * task.factor * (task.class_weights or (1,) * task.classes)[tracks[task.label][t]]
                loss -= w * np.log(p[tracks[task.label][t]])
                gradient[:, at : at + task.classes] += w * np.outer(x, p - np.eye(task.classes)[tracks[task.label][t]])
                at += task.classes
            n += 1
    return gradient, loss, n


def test_sums_match_a_dense_computation_however_windows_are_dealt_out(spark, tables):
    tasks = (training.Task("ann", 4, "weight", 1.0, (0.5, 1.0, 2.0, 1.0)), *training.TASKS[1:])
    model = training.ContextClassifier(np.random.default_rng(3).normal(size=(21, 10)), REACH, tasks)
    gradient, loss, n = training.gradient_sums(tables[0], model, FLANK)
    wanted = dense(windows(40, 1), model.weights, tasks)
    assert np.allclose(gradient, wanted[0], atol=1e-4) and loss == pytest.approx(wanted[1], rel=1e-7) and n == wanted[2] == 2000
    again = training.gradient_sums(tables[0].repartition(7), model, FLANK)
    assert (again[0] == gradient).all() and again[1:] == (loss, n)


def test_confusions_match_a_count_by_hand(spark, tables):
    model = training.ContextClassifier(np.random.default_rng(4).normal(size=(21, 10)), REACH)
    got = {(r["task"], r["label"], r["pred"]): r["n"] for r in training.confusions(tables[1], model, FLANK).collect()}
    wanted = {}
    for _, _, _, seq, ann, weight, step, mask, phase in windows(10, 2):
        p = model.probabilities(model.one_hot(seq, FLANK))
        for k, (label, w) in enumerate(((ann, weight), (step, mask), (phase, weight))):
            for t in range(len(ann)):
                if w[t]:
                    key = (k, label[t], int(p[k][t].argmax()))
                    wanted[key] = wanted.get(key, 0) + 1
    assert got == wanted


def test_loss_falls_and_a_resumed_run_equals_an_unbroken_one(spark, tables, tmp_path):
    options = dict(flank=FLANK, reach=REACH, rate=0.01, patience=9)
    whole = training.train(*tables, str(tmp_path / "a"), rounds=5, **options).orderBy("round").collect()
    assert [r["round"] for r in whole] == list(range(5)) and all(a["loss"] > b["loss"] for a, b in zip(whole, whole[1:]))
    training.train(*tables, str(tmp_path / "b"), rounds=2, **options)
    # A round that was lost between its weights and the log is done again.
    spark.createDataFrame([(0, 0, 9.0, 9.0)], training._WEIGHTS).write.parquet(str(tmp_path / "b/weights/round=2"))
    resumed = training.train(tables[0].repartition(5), tables[1], str(tmp_path / "b"), rounds=5, **options).orderBy("round").collect()
    assert resumed == whole
    one, two = (training.load(spark, str(tmp_path / x), 4, REACH) for x in "ab")
    assert (one[0].weights == two[0].weights).all() and (one[1] == two[1]).all()


def test_training_stops_once_nothing_gets_better(spark, tables, tmp_path):
    done = training.train(*tables, str(tmp_path / "c"), flank=FLANK, reach=REACH, rounds=9, rate=0.0, patience=2).orderBy("round").collect()
    assert [r["round"] for r in done] == [0, 1, 2] and [r["improved"] for r in done] == [True, False, False] and done[-1]["stopped"]
    assert training.train(*tables, str(tmp_path / "c"), flank=FLANK, reach=REACH, rounds=9, rate=0.0, patience=2).count() == 3
    with pytest.raises(ValueError, match="flank"):
        training.train(*tables, str(tmp_path / "d"), flank=1, reach=REACH)
    assert training.log(spark, str(tmp_path / "d")).count() == 0


def test_windows_of_several_lengths_are_dealt_with_together(spark):
    """Sums over windows do not depend on which are beside one, and a batch is a few steps, not one a window."""
    rows = [*windows(30, 5), *windows(20, 6, 33), *windows(1, 7, 2)]
    table, model = spark.createDataFrame(rows, SCHEMA).coalesce(1), training.ContextClassifier(np.random.default_rng(8).normal(size=(21, 10)), REACH)
    gradient, loss, n = training.gradient_sums(table, model, FLANK)
    wanted = dense(rows, model.weights)
    assert np.allclose(gradient, wanted[0], atol=1e-4) and loss == pytest.approx(wanted[1], rel=1e-7) and n == wanted[2] == 30 * 50 + 20 * 33 + 2
    alone = training.gradient_sums(table.repartition(40), model, FLANK)
    assert (alone[0] == gradient).all() and alone[1:] == (loss, n)
    batch = table.toArrow().combine_chunks().to_batches()[0]
    assert sorted(len(codes) for codes, _, _ in training._windows(batch, model, FLANK)) == [1, 20, 30]
