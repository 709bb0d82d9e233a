"""What a pass of the model fits reads and writes."""

import glob

import numpy as np
import pyarrow as pa

from riskflow.operators import boosting, logistic, ml
from riskflow.session import block_scans, ensure_checkpoint_dir
from riskflow.states import STATES


def training_rows(spark, n=400):
    r = np.random.default_rng(4)
    rows = [(float(r.integers(0, 9)), float(r.integers(0, 5)), STATES[int(r.integers(0, 4))]) for _ in range(n)]
    return spark.createDataFrame(rows, "a double, b double, next_risk_state string")


def test_hessian_of_the_last_class_follows_from_the_others():
    r = np.random.default_rng(1)
    x, y, w, theta = r.normal(size=(50, 4)), r.integers(0, 4, 50), r.random(50) + 0.5, r.normal(size=(4, 4))
    p = logistic._softmax(x @ theta.T)
    want = np.einsum("n,na,nab,ni,nj->aibj", w, p, np.eye(4)[None] - p[:, None, :], x, x)
    assert np.allclose(logistic.sums(x, y, w, theta, True)[2], want, atol=1e-12)


def test_a_written_set_is_not_copied_before_its_weights(spark):
    def copies():
        return len(glob.glob(ensure_checkpoint_dir(spark).replace("file:", "") + "/riskflow-labelled-*"))
    before = copies()
    one = ml.training_table(training_rows(spark), ["a", "b"], written=True)
    assert copies() == before
    two = ml.training_table(training_rows(spark), ["a", "b"])
    assert sorted(one.collect()) == sorted(two.collect())


def test_numbers_of_a_slice_of_byte_strings():
    rows = [np.arange(i, i + 3, dtype=np.float64) for i in range(6)]
    column = pa.array([x.tobytes() for x in rows], pa.binary())
    assert (boosting._numbers(column.slice(2, 3), np.float64, 3) == np.array(rows[2:5])).all()
    assert boosting._numbers(column.slice(2, 0), np.float64, 3).shape == (0, 3)


def test_leaves_of_rows_beyond_a_block(monkeypatch):
    monkeypatch.setattr(boosting, "CACHED_ROWS", 7, raising=False)
    t = boosting.Tree()
    low, _ = t.split(0, 0, 3, 3.0)
    t.split(low, 1, 1, 1.0)
    x = np.random.default_rng(2).integers(0, 8, (40, 2)).astype(np.uint8)
    want = [(3 if b <= 1 else 4) if a <= 3 else 2 for a, b in x]
    assert t.leaves(x, t.bin).tolist() == want
    assert t.leaves(np.array([[np.nan, 0.0]]), t.threshold).tolist() == [2]


def test_a_pass_adds_no_older_trees(spark, monkeypatch):
    """Every round's trees are added to the rows' scores once, whatever the number of rounds."""
    table, found = ml.training_table(training_rows(spark), ["a", "b"]), []
    scored = boosting._scored
    monkeypatch.setattr(boosting, "_scored", lambda rows, newer, n: found.append(len(newer)) or scored(rows, newer, n))
    model = boosting.fit(table, ["a", "b"], rounds=12, depth=2)
    assert found == [1] * 11
    monkeypatch.setattr(boosting, "STAGE_ROUNDS", 1)
    again = boosting.fit(table, ["a", "b"], rounds=12, depth=2)
    assert [[t.__dict__ for t in x] for x in model.rounds] == [[t.__dict__ for t in x] for x in again.rounds]


def test_a_boosted_pass_reads_blocks_of_rows(spark, monkeypatch):
    """Blocks hold every row once, with its number in the table, whatever their size."""
    table = ml.training_table(training_rows(spark), ["a", "b"]).coalesce(2)
    cuts = boosting.quantile_cuts(table, ["a", "b"], 8)
    found, trees = [], []
    for size in (boosting.BLOCK_ROWS, 7):
        monkeypatch.setattr(boosting, "BLOCK_ROWS", size)
        rows = boosting._binned(table, ["a", "b"], cuts, "weight")
        assert rows.count() <= 2 if size > 7 else rows.count() >= 400 / 7
        batch = rows.toArrow().combine_chunks().to_batches()[0]
        found.append(sorted((int(i), *map(int, bins), int(y), float(w)) for rid, x, y_, w_, m in boosting._arrays(batch, 2)
                            for i, bins, y, w in zip(rid, x.T, y_, w_)))
        model = boosting.fit(table, ["a", "b"], rounds=2, depth=3, cuts=cuts)
        trees.append([[t.__dict__ for t in x] for x in model.rounds])
    want = sorted((r.rid, int(np.searchsorted(cuts[0], r.a)), int(np.searchsorted(cuts[1], r.b)), int(r.label), r.weight)
                  for r in table.selectExpr("monotonically_increasing_id() AS rid", "*").collect())
    assert found == [want, want] and trees[0] == trees[1]


def test_a_logistic_fit_writes_and_reads_blocks_only(spark):
    def written(name):
        return len(glob.glob(ensure_checkpoint_dir(spark).replace("file:", "") + f"/riskflow-{name}-*"))
    rows = training_rows(spark).selectExpr("*", "0.1D AS c")
    before = written("training"), written("packed")
    model = ml.fit_logistic(rows, ["a", "b", "c"], written=True)
    assert (written("training"), written("packed")) == (before[0], before[1] + 1)
    table = ml.training_table(rows, ["a", "b", "c"])
    blocks = logistic.packed(table, ["a", "b", "c"])
    assert blocks.count() <= table.rdd.getNumPartitions()
    mean, std = logistic.statistics(blocks, 3)
    x = np.array([list(r) for r in table.select("a", "b", "c").collect()])
    assert np.allclose(mean, x.mean(axis=0), rtol=1e-12) and np.allclose(std[:2], x.std(axis=0)[:2], rtol=1e-12)
    assert std[2] == 0.0
    assert logistic.statistics(logistic.packed(table.limit(0), ["a", "b", "c"]), 3) == ([None] * 3, [None] * 3)
    again = ml.fit_logistic(table, ["a", "b", "c"])
    assert np.allclose(model.models[0].coefficients, again.models[0].coefficients, atol=1e-9)


def test_a_forest_grows_on_tasks_of_like_size(spark, monkeypatch):
    """Tasks cut by bytes differ in rows; a small table keeps its own."""
    one = spark.range(0, 20, numPartitions=2).union(spark.range(20, 1000, numPartitions=1))
    assert ml.even_tasks(one) is one
    monkeypatch.setattr(ml, "EVEN_ROWS", 100)
    even = ml.even_tasks(one)
    sizes = even.selectExpr("_metadata.file_path AS p").groupBy("p").count().toPandas()["count"]
    assert sizes.max() <= 1.5 * 1000 / len(sizes) and sizes.max() <= 150 and sorted(r.id for r in even.collect()) == list(range(1000))
    seen = []
    monkeypatch.setattr(ml, "even_tasks", lambda d: seen.append(d.columns) or d)
    ml.fit_forest(ml.training_table(training_rows(spark), ["a", "b"]), ["a", "b"], num_trees=2, max_depth=2)
    assert seen == [["_features", "label", "weight"]]


def test_a_logistic_fit_reads_its_rows_once(spark, monkeypatch):
    """Rows are formed into the fit's blocks only; classes are counted there, and a pass has a task per file."""
    seen, rows = spark.sparkContext.accumulator(0), training_rows(spark).repartition(3)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    passed = rows.mapInArrow(counted, rows.schema)
    model = ml.fit_logistic(passed, ["a", "b"])
    assert seen.value == 400
    table = ml.training_table(rows, ["a", "b"])
    assert np.allclose(model.models[0].coefficients, ml.fit_logistic(table, ["a", "b"]).models[0].coefficients, atol=1e-9)
    blocks = logistic.packed(ml.with_label(rows, "next_risk_state").repartition(5), ["a", "b"], None)
    assert logistic.label_weights(blocks) == {int(r.label): r.weight for r in table.select("label", "weight").distinct().collect()}
    with block_scans(spark):
        assert spark.read.parquet(*blocks.inputFiles()).rdd.getNumPartitions() == len(blocks.inputFiles()) > 1
    assert spark.conf.get("spark.sql.parquet.enableVectorizedReader") == "true"


def test_the_hessian_is_rebuilt_from_its_parts():
    r = np.random.default_rng(3)
    x, y, w, theta = r.normal(size=(60, 5)), r.integers(0, 4, 60), r.random(60) + 0.5, r.normal(size=(4, 5))
    hess = logistic.sums(x, y, w, theta, True)[2]
    pairs, upper = logistic._triangles(4, 5)
    flat = np.concatenate([hess[a, :, b, :][upper] for a, b in pairs])
    assert np.allclose(logistic._whole(flat, 4, 5), hess.reshape(20, 20), atol=1e-12)


def test_a_siblings_sums_are_what_is_left_of_the_parents(spark):
    """Rows are added up for one of two siblings; the other's sums and split are those of its own rows."""
    table = ml.training_table(training_rows(spark), ["a", "b"])
    cuts = boosting.quantile_cuts(table, ["a", "b"], 8)
    rows = boosting._binned(table, ["a", "b"], cuts, "weight")
    params = {"widths": [len(c) + 1 for c in cuts], "seed": 1, "subsample": 0.8, "penalty": 1.0, "least_weight": 0.0}
    columns, trees = [np.array([0, 1])] * 4, [boosting.Tree() for _ in STATES]

    def level(frontier, above=None):
        return boosting._level(rows, trees, frontier, above, columns, 8, 0, 2.0 ** 30, params)
    above = level([(0, -1, 0, -1)])
    root = above.first()
    low, high = trees[0].split(0, root.feature, root["at"], 0.0)
    both = {r.node: r for r in level([(0, 0, low, high)], above).collect()}
    each = {r.node: r for n in (low, high) for r in level([(0, -1, n, -1)]).collect()}
    assert both == each and set(both) == {low, high} and root.h == both[low].h + both[high].h
