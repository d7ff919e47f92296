"""Every query of the catalogue against its SQL in DuckDB, and what SQL can't say."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from alignspark.functions import hof
from alignspark.operators import lattice, relational, tiles, training
from alignspark.operators.ml import PairClassifier
from alignspark.operators.scoring import Parameters, balanced, class_log_weights, score
from alignspark.plans import queries
from alignspark.sources import pairs
from alignspark.spec import FeatureSpec, StateMachine
from alignspark.streaming.scoring import score_stream, scored_to

TABLES = "part customer supplier benchmark".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(frame):
    return sorted(map(tuple, frame[sorted(frame.columns)].astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, sf, duck, name):
    got, want = queries.QUERIES[name](spark, sf).toPandas(), duck.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_backward_is_consistent(spark, sf):
    """A lattice's ways, split at any node, are all ways: sums over a cut agree with the whole weight."""
    ahead, back = queries.QUERIES["forward_nodes"](spark, sf), queries.QUERIES["backward_nodes"](spark, sf)
    z = queries.QUERIES["class_logz"](spark, sf)
    both = ahead.where("j = 0").join(back.withColumnRenamed("w", "b"), ["pair_id", "i", "j", "s"]).where("i = 0").join(z, "pair_id")
    wrong = both.where(F.abs(F.col("w") + F.col("b") - F.when(F.col("s") == 0, F.col("z0")).otherwise(F.col("z1"))) > 2e-4)
    assert both.count() and not wrong.count()
    assert queries.QUERIES["backward_edges"](spark, sf).count() == queries.QUERIES["lattice_default"](spark, sf).count()


def test_long_strings(spark, sf):
    got = queries.QUERIES["predict_long_strings"](spark, sf).collect()
    assert len(got) == pairs.table(spark, sf, "benchmark").count() - 1
    assert all(abs(r["p0"] + r["p1"] - 1) < 2e-4 for r in got)


def test_edges(spark, sf):
    got = {r["pair_id"]: r for r in score(pairs.edges(spark, sf), queries.MODEL).collect()}
    assert len(got) == pairs.table(spark, sf, "part").count()
    for i, r in got.items():
        if i % 8 in (0, 1, 2):
            assert r["probability"] is None and r["prediction"] is None
        else:
            assert abs(sum(r["probability"]) - 1) < 1e-9


# Probabilities of class 0 of pairs.WORDS under the fixed parameters, by all alignments and by the best one,
# and the machines' edges for lengths 2 and 3.
WORDS_ALL = [0.5227226, 0.52568993, 0.4547091, 0.51179222, 0.46347576, 0.45710098, 0.46159657, 0.42997978, 0.47419724, 0.50797852]
WORDS_BEST = [0.56394611, 0.52977205, 0.4751729, 0.51183761, 0.48608081, 0.4986367, 0.46947222, 0.43233544, 0.47463002, 0.51265109]


@pytest.mark.parametrize(("best", "want"), [(False, WORDS_ALL), (True, WORDS_BEST)])
def test_fixed_parameters_and_fitted_ones(spark, best, want):
    source = pairs.words(spark)
    fixed = score(source, Parameters(queries.SPEC, queries.TWO, queries.THETA), best).orderBy("pair_id").collect()
    assert np.allclose([r["probability"][0] for r in fixed], want, atol=1e-6)
    fitted = score(source, training.fit(source, queries.SPEC, l2=10.0)[0], best).orderBy("pair_id").collect()
    assert np.allclose([r["probability"][0] for r in fitted], want, atol=1.5e-3)
    assert [r["prediction"] for r in fitted] == ["0" if p > 0.5 else "1" for p in want]


def test_fixed_lattices(spark):
    source = spark.createDataFrame([(0, "ab", "abc"), (1, "", "a"), (2, None, "a")], "pair_id long, s1 string, s2 string")
    jump = [(0, 0, 0, 0, 1, 0, 0, 4), (0, 1, 0, 0, 1, 2, 1, 3)]
    call = [(0, 0, 0, 0, 1, 0, 0, 6), (0, 0, 0, 0, 1, 1, 0, 4), (0, 1, 0, 0, 1, 2, 3, 7), (0, 1, 1, 0, 1, 2, 1, 5)]
    assert sorted(map(tuple, lattice.lattice(source, queries.JUMP).collect())) == jump
    assert sorted(map(tuple, lattice.lattice(source, queries.CALLS).collect())) == call
    assert sorted(map(tuple, relational.lattice(source, queries.JUMP, relational.shared(spark, "lattice")).collect())) == jump


def test_a_caller_s_optimiser(spark):
    def descend(objective, x, step, turns):
        for _ in range(turns):
            x = x - step * objective(x)[1]
        return x, objective(x)[0]

    _, history = training.fit(pairs.words(spark), queries.SPEC, l2=1.0, optimizer=descend, optimizer_kwargs={"step": 1e-3, "turns": 5})
    assert len(history) == 6 and all(b > a for a, b in zip(history, history[1:], strict=False))


def test_higher_order_functions_agree(spark):
    source = pairs.words(spark)
    both = score(source, queries.MODEL, True, ["s1", "s2"]).withColumn("p", hof.probabilities(queries.NUMERIC, queries.SPEC, 2, best=True)).collect()
    assert all(np.allclose(r["probability"], r["p"]) for r in both)


def test_partitions_change_nothing(spark, sf):
    source = pairs.parts(spark, sf)
    one = {r["pair_id"]: r["probability"] for r in score(source.coalesce(1), queries.MODEL).collect()}
    many = {r["pair_id"]: r["probability"] for r in score(balanced(source, 5), queries.MODEL).collect()}
    assert one.keys() == many.keys() and all(np.allclose(one[k], many[k]) for k in one)


def test_estimator(spark):
    source = pairs.words(spark)
    estimator = PairClassifier(spec=queries.SPEC, l2=10.0)
    assert estimator.get_params()["l2"] == 10.0
    assert estimator.set_params(viterbi=True).get_params()["l2"] == 10.0
    model = estimator.fit(source)
    assert model.classes == ["0", "1"]
    out = model.transform(source)
    assert set(out.columns) >= {"pair_id", "s1", "s2", "label", "probability", "prediction"}
    assert out.where("prediction = label").count() == 7
    free = PairClassifier(spec=queries.SPEC, l2=0.0).fit(source).transform(source)
    assert free.where("prediction = label").count() == 10


def test_labels_and_probabilities_have_one_order(spark):
    rows_ = [(0, "helloooo", "hello", "match"), (1, "h0me", "home", "match"), (2, "krazii", "crazy", "match"), (3, "non matching string example", "no really", "non-match"), (4, "and another one", "yep", "non-match")]
    source = spark.createDataFrame(rows_, "pair_id long, s1 string, s2 string, label string")
    out = PairClassifier(spec=queries.SPEC, l2=1.0).fit(source).transform(source).orderBy("pair_id").collect()
    assert [r["prediction"] for r in out] == [r["label"] for r in out]
    assert np.allclose([r["probability"][0] for r in out], [0.94914812, 0.92397711, 0.86756034, 0.05438812, 0.02641275], atol=3e-3)  # the penalty spares one number, which depends on the classes' order


def test_saved_in_a_pipeline(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel

    source = pairs.words(spark)
    model = Pipeline(stages=[PairClassifier(spec=queries.SPEC, l2=10.0, iterations=5, viterbi=True)]).fit(source)
    model.write().overwrite().save(str(tmp_path / "model"))
    back = PipelineModel.load(str(tmp_path / "model"))
    again = back.transform(model.transform(source))  # columns of the same names are replaced
    assert again.columns.count("probability") == again.columns.count("prediction") == 1
    assert back.stages[0].uid == model.stages[0].uid and back.stages[0].getOrDefault("viterbi")
    assert [r["probability"] for r in again.orderBy("pair_id").collect()] == [r["probability"] for r in model.transform(source).orderBy("pair_id").collect()]


def test_a_caller_s_own_machine(spark):
    class Own:
        start_states, transitions, states_to_classes = queries.TWO.start_states, queries.TWO.transitions, dict(queries.TWO.states_to_classes)

    parameters, history = training.fit(pairs.words(spark), queries.SPEC, l2=10.0, machine=Own(), iterations=3)
    assert parameters.machine == queries.TWO and history[-1] > history[0]


def test_equal_pairs_are_scored_once(spark, monkeypatch):
    rows = [("green", "gr33n", "match"), ("red", "rred", "match"), ("blue", "lue", "match"), ("green", "salmon", "non-match"), ("red", "lavender", "non-match"), ("", "red", "non-match")]
    many = spark.createDataFrame([(7 * i + k, *r) for i in range(20) for k, r in enumerate(rows)], "pair_id long, s1 string, s2 string, label string")
    asked = []
    monkeypatch.setattr(queries.PairClassifierModel, "_transform", lambda self, given, make=queries.PairClassifierModel._transform: asked.append(given.count()) or make(self, given))
    found = {r["label"]: (r["good"], r["pairs"]) for r in queries._learned(many, queries.PairClassifier(spec=queries.SPEC, l2=0.01, iterations=15), 0.9).collect()}
    assert found == {"match": (True, 60), "non-match": (True, 60)}  # an empty name has no prediction, but is a pair
    assert asked == [6]


def test_equal_pairs_are_counted(spark):
    """Repeated pairs train as their count; null ones not at all; sequences of words as well."""
    words = pairs.words(spark)
    odd = spark.createDataFrame([(90, None, "a", "0"), (91, "a", None, "0"), (92, "a", "b", None), (93, "", "b", "1")], words.schema)
    many = words.unionByName(words).unionByName(words.where("pair_id < 4")).unionByName(odd)
    batches = training.encoded_batches(training.counted(many, 3), queries.SPEC, queries.TWO)
    got, want = training.summed(batches, queries.MODEL), training.log_likelihood(many, queries.MODEL)
    assert got[0] == pytest.approx(want[0]) and np.allclose(got[1], want[1])
    assert training.counted(many, 3).count() == 11
    tokens = words.select(F.split("s1", "").alias("s1"), F.split("s2", "").alias("s2"), "label")
    assert training.log_likelihood(tokens, queries.MODEL)[0] == pytest.approx(training.log_likelihood(words, queries.MODEL)[0])
    with pytest.raises(ValueError):
        training.fit(spark.range(1500).selectExpr("'a' AS s1", "'b' AS s2", "id AS label"), queries.SPEC)


def test_callable_moves_train(spark):
    words = pairs.words(spark)
    machine = StateMachine((0, 1), tuple((a, b, (lambda d: lambda i, j, x: d)(d)) for a, b, d in queries.TWO.transitions), dict(queries.TWO.states_to_classes))
    got, want = (training.log_likelihood(words, Parameters(queries.SPEC, m, queries.NUMERIC)) for m in (machine, queries.TWO))
    assert got[0] == pytest.approx(want[0]) and np.allclose(got[1], want[1])


@pytest.mark.parametrize("tile", [2000, 3])
def test_near_pairs(spark, tile):
    import random

    rng = random.Random(3)
    names = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 14))) for _ in range(120)]
    names += [n[:4] + "x" + n[4:] for n in names[:30]] + ["aaaaaaaaaa", "aaaaaaaaa", "bab", None]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    source = spark.createDataFrame(list(enumerate(names)), "id long, s string")
    for most in (0, 1, 2):
        want = {(i, j) for i, a in enumerate(names) for j, b in enumerate(names) if i < j and None not in (a, b) and distance(a, b) <= most}
        got = [(r["id"], r["id2"]) for r in pairs.near(source, most, 2, tile).collect()]
        assert len(got) == len(want) and set(got) == want


def test_gradients_are_added_in_groups(spark, monkeypatch):
    source = pairs.words(spark)
    one = training.log_likelihood(source, queries.MODEL, 1)
    monkeypatch.setattr(training, "FAN", 2)
    many = training.log_likelihood(source.repartition(7), queries.MODEL)
    assert one[0] == pytest.approx(many[0]) and np.allclose(one[1], many[1])


@pytest.mark.parametrize("best", [False, True])
def test_tiles_give_what_whole_lattices_give(spark, best):
    """All machines and features whose moves cross tiles' borders; empty and null texts, and tiles longer than texts."""
    rng = np.random.default_rng(3)
    text = lambda n: "".join(rng.choice(list("ab7"), n))
    rows_ = [(0, text(37), text(23)), (1, text(8), text(8)), (2, text(1), text(30)), (3, "", "a"), (4, None, "a"), (5, text(16), text(17))]
    source = spark.createDataFrame(rows_, "pair_id long, s1 string, s2 string")
    spec = FeatureSpec(start=True, end=True, match=True, numeric=True, transition=True)
    for machine in (queries.TWO, queries.GENERAL):
        model = Parameters(spec, machine, rng.normal(0, 0.2, (machine.n_states + machine.n_transitions, spec.size)))
        want = {r["pair_id"]: r["weights"] for r in class_log_weights(source, model, best).collect()}
        for tile in (8, 100):
            got = {r["pair_id"]: r["weights"] for r in tiles.class_log_weights(source, model, tile, best).collect()}
            assert got.keys() == want.keys() and all((got[k] is None) == (want[k] is None) and (want[k] is None or np.allclose(got[k], want[k])) for k in want)


def test_a_huge_pair_is_shared_by_tasks(spark):
    rng = np.random.default_rng(4)
    one, two = ("".join(rng.choice(list("abcdef"), n)) for n in (5000, 4300))
    source = spark.createDataFrame([(0, one, two)], "pair_id long, s1 string, s2 string")
    got = tiles.class_log_weights(source, queries.MODEL, 1000).first()["weights"]
    assert np.allclose(got, class_log_weights(source, queries.MODEL).first()["weights"])


def test_own_lattices_train_and_show(spark):
    """An object that only builds lattices: as the default machine where its band holds all cells."""

    class Whole(queries.Banded):
        width = 100

    source = pairs.words(spark)
    model = Parameters(queries.SPEC, StateMachine.of(Whole()), queries.NUMERIC)
    assert model.machine.classes == ["0", "1"] and StateMachine.of(model.machine) is model.machine
    plain = Parameters(queries.SPEC, queries.TWO, queries.NUMERIC)
    for f in (lambda m: score(source, m), lambda m: score(source, m, best=True)):
        assert np.allclose([r["probability"] for r in f(model).orderBy("pair_id").collect()], [r["probability"] for r in f(plain).orderBy("pair_id").collect()])
    got, want = (training.log_likelihood(source, m) for m in (model, plain))
    assert got[0] == pytest.approx(want[0]) and np.allclose(got[1], want[1])
    assert sorted(map(tuple, lattice.lattice(source, model.machine, queries.SPEC).collect())) == sorted(map(tuple, lattice.lattice(source, queries.TWO).collect()))
    fitted, history = training.fit(source, queries.SPEC, l2=10.0, machine=Whole(), iterations=3)
    assert history[-1] > history[0] and fitted.machine.states_to_classes == ((0, "0"), (1, "1"))


def test_streams(spark, tmp_path):
    source = pairs.words(spark)
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    scored_to(stream, queries.MODEL, str(tmp_path / "out"), str(tmp_path / "at")).start().awaitTermination()
    got = {r["pair_id"]: r["probability"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["pair_id"]: r["probability"] for r in score(source, queries.MODEL).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    with pytest.raises(ValueError):
        score_stream(source, queries.MODEL)


def test_candidates(spark):
    source = spark.createDataFrame([(i, f"name{i % 7}", i % 2 if i < 40 else None) for i in range(45)], "id long, s string, block int")
    for tile in (2000, 3):
        got = [(r["id"], r["id2"]) for r in pairs.candidates(source, "block", tile).collect()]
        assert sorted(got) == [(a, b) for a in range(40) for b in range(a + 1, 40) if a % 2 == b % 2]


def test_shape_of_theta():
    with pytest.raises(ValueError):
        Parameters(queries.SPEC, queries.TWO, np.zeros((3, 3)))


def test_sql_functions(spark):
    from alignspark.functions import sql

    sql.register(spark, queries.MODEL, "proba")
    pairs.words(spark).createOrReplaceTempView("word_pairs")
    assert spark.sql("SELECT count(*) n FROM word_pairs, LATERAL pair_lattice(s1, s2)").first()["n"] > 100
    assert spark.sql("SELECT count(*) n FROM word_pairs, LATERAL pair_features(s1, s2) WHERE k = 0").first()["n"] == sum(len(a) * len(b) for a, b, _ in pairs.WORDS)
    assert spark.sql("SELECT proba('', 'a') p").first()["p"] is None


def _plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_pairs_are_dealt_to_tasks(spark, sf):
    """Tables of names are one small file, but what comes of a pair is large."""
    for source in (pairs.parts, pairs.typos, pairs.edges):
        assert source(spark, sf).select(F.spark_partition_id().alias("k")).distinct().count() > 1


#: State 2 is reached and no class names it, so ways that end there are no alignments.
DEAD = StateMachine((0,), ((0, 0, (1, 1)), (0, 0, (0, 1)), (0, 2, (1, 1)), (2, 0, (1, 0)), (0, 0, (1, 0)), (1, 1, (1, 1))), {0: "0", 1: "1"})


def test_posteriors_shuffle_no_lattice(spark):
    source = spark.createDataFrame([(0, "ab3", "a3c"), (1, "abc", "b"), (2, "", "a"), (3, None, "b")], "pair_id long, s1 string, s2 string")
    theta = np.random.default_rng(1).normal(0, 0.5, (DEAD.n_states + DEAD.n_transitions, 3))
    for model in (queries.MODEL, Parameters(queries.SPEC, DEAD, theta)):
        found = relational.posteriors(source, model)
        assert "Exchange" not in _plan(found) and "Join" not in _plan(found)
        rows_ = found.collect()
        assert {r["pair_id"] for r in rows_} == {0, 1} and all(0 < r["p"] <= 1 + 1e-9 for r in rows_)
        ends = [r for r in rows_ if r["i0"] is None and (r["i"], r["j"]) == ((2, 2) if r["pair_id"] == 0 else (2, 0))]
        assert ends and all(r["p"] == pytest.approx(1.0) for r in ends)
    labelled = source.withColumn("label", F.lit("1"))
    summed = relational.gradient(labelled, queries.MODEL)
    assert "Join" not in _plan(summed)
    want = training.log_likelihood(labelled, queries.MODEL)[1]
    got = np.zeros_like(want)
    for r in summed.collect():
        got[r["row"], r["k"]] = r["value"]
    assert np.allclose(got, want)


def test_frontiers_are_joined_once_for_each_shape(spark, monkeypatch):
    source = spark.range(40).selectExpr("id AS pair_id", "'abcd' AS s1", "if(id % 2 = 0, 'xyz', 'wxyz') AS s2")
    for sent in (relational.SENT, 0):
        monkeypatch.setattr(relational, "SENT", sent)
        at = relational.shared(spark, "lattice")
        found = sorted(map(tuple, relational.lattice(source, queries.GENERAL, at).collect()))
        nodes = spark.read.parquet(f"{at}/nodes")
        assert nodes.count() == nodes.distinct().count() and nodes.select("n1", "n2").distinct().count() == 2
        assert found == sorted(map(tuple, lattice.lattice(source, queries.GENERAL).collect()))


def test_slopes_of_many_pairs_at_once():
    from alignspark.operators import encoded

    first, second, labels = ["abc", "a7", "", "bca", "abcabc"], ["abd", "7a", "a", "c", "b3"], ["0", "1", "0", "1", "0"]
    for spec, machine in ((queries.SPEC, queries.MIXED), (queries.TRANSITIONS, queries.TWO)):
        theta, direction = np.random.default_rng(2).normal(0, 0.2, (2, machine.n_states + machine.n_transitions, spec.size))
        got = {}
        for at, batch in encoded.encode_rows(first, second, labels, [1.0] * 5, spec, machine):
            got |= dict(zip(at.tolist(), zip(*encoded.loss_slopes(batch, spec, machine, theta, direction), strict=True), strict=True))
        assert sorted(got) == [0, 1, 3, 4]
        for r, pair in got.items():
            (batch,) = encoded.encode([first[r]], [second[r]], [labels[r]], [1.0], spec, machine)
            value, gradient = encoded.loss_gradient(batch, spec, machine, theta)
            assert pair == pytest.approx((value, (gradient * direction).sum()))


def test_higher_order_functions_walk_each_lattice_once(spark):
    text = pairs.words(spark).select(hof.probabilities(queries.NUMERIC, queries.SPEC, 2).alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("split(s1") == 2  # once a class


def test_vectorised_rows_are_the_table_functions_rows(spark):
    from alignspark.functions import sql

    sql.register(spark, Parameters(queries.FULL, queries.TWO, np.zeros((8, queries.FULL.size))), "rows_proba", prefix="rows")
    spark.createDataFrame([(0, "ab 1", "b1"), (1, "", "a"), (2, None, "a"), (3, "é", "x")], "pair_id long, s1 string, s2 string").createOrReplaceTempView("row_pairs")
    for name, kind in (("features", "feature"), ("lattice", "lattice")):
        one = spark.sql(f"SELECT pair_id, f.* FROM row_pairs, LATERAL rows_{name}(s1, s2) f")
        many = spark.sql(f"SELECT pair_id, inline(rows_{kind}_rows(s1, s2)) FROM row_pairs")
        assert one.columns == many.columns and sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect())) != []
    none = spark.sql("SELECT rows_feature_rows(s1, s2) AS f FROM row_pairs WHERE pair_id IN (1, 2)").collect()
    assert [r["f"] for r in none] == [None, None]


def test_near_of_copies_and_long_strings(spark):
    base = "abcdefghij" * 7
    names = ["x1", "x1", "x1", "x2", "x", "", "", "aab", "ab", base[:64], base[:65], base[:66], base[:65] + "z", base[:63] + "z", "é", "ab"]
    source = spark.createDataFrame(list(enumerate(names)), "id long, s string")
    a, b = source.selectExpr("id", "s AS s1"), source.selectExpr("id AS id2", "s AS s2")
    want = sorted(map(tuple, a.join(b, F.expr("id < id2 AND levenshtein(s1, s2) <= 1")).select("id", "id2", "s1", "s2").collect()))
    assert sorted(map(tuple, pairs.near(source, 1).collect())) == want
    texts = source.select("s", F.length("s").alias("n")).distinct()
    met = pairs._by_one_edit(texts).collect()
    assert len(met) == len(set(met)) > 0
