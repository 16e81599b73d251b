from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sieve.operators import attribution as A
from sieve.operators import encoding as E
from sieve.operators import metrics as M
from sieve.operators import model as L
from sieve.operators.encoding import _keep_longest_first
from sieve.operators.spool import new_dir
from sieve.plans.explaining import explained, readable
from sieve.plans.screening import judged, screen

WORDS = "alpha beta gamma delta trial control blood test Test serum cohort 12 über".split()


@pytest.fixture(scope="module")
def docs():
    rnd = random.Random(5)

    def text(y, n):
        pool = WORDS + (["alpha", "trial"] * 3 if y else ["control", "blood"] * 3)
        return " ".join(rnd.choice(pool) for _ in range(n)) + "."

    out = []
    for t, n in (("big", 200), ("tiny", 24)):
        for i in range(n):
            y = int(rnd.random() < 0.4)
            out.append((t, f"{t}{i}", text(y, 4), text(y, rnd.randint(5, 30)), y))
    out += [("none", f"n{i}", "a", "b", 0) for i in range(5)]
    out += [("big", "gap", None, "x", 1)]
    return out


@pytest.fixture(scope="module")
def screening(spark, docs):
    schema = "topic_id string, pid string, title string, abstract string, relevance int"
    return screen(spark.createDataFrame(docs, schema))


def toks(text):
    return re.findall(r"\w+|[^\w\s]", text)


@pytest.fixture(scope="module")
def brute(screening):
    """Weights and priors by plain Python."""
    train = [r for r in screening.train.collect()]
    weights, priors = {}, {}
    for topic in {r["topic_id"] for r in train}:
        counts = {0: Counter(), 1: Counter()}
        n = Counter()
        for r in train:
            if r["topic_id"] == topic:
                n[r["relevance"]] += 1
                counts[r["relevance"]].update(t.lower() for t in toks(r["title"]) + toks(r["abstract"]))
        vocab = set(counts[0]) | set(counts[1])
        p, q, v = sum(counts[1].values()), sum(counts[0].values()), len(vocab)
        for w in vocab:
            weights[topic, w] = math.log((counts[1][w] + 1) / (p + v)) - math.log((counts[0][w] + 1) / (q + v))
        priors[topic] = math.log(n[1] / n[0])
    return weights, priors


def test_split_is_balanced_and_complete(screening):
    rows = screening.split.collect()
    assert not any(r["pid"] == "gap" for r in rows)
    for t in ("big", "tiny"):
        mine = [r for r in rows if r["topic_id"] == t]
        assert sum(r["relevance"] for r in mine) * 2 == len(mine)
        assert sum(r["is_test"] for r in mine) == math.ceil(len(mine) / 4)
    assert not any(r["topic_id"] == "none" for r in rows)


def test_weights(screening, brute):
    got = {(r["topic_id"], r["token"]): r["weight"] for r in screening.model.weights.df.collect()}
    assert got.keys() == brute[0].keys()
    assert all(abs(got[k] - brute[0][k]) < 1e-6 for k in got)


def test_scores_and_attributions_agree(screening, brute):
    weights, priors = brute
    logits = {r["pid"]: r["logit"] for r in screening.predictions().collect()}
    sums = defaultdict(float)
    for r in A.attributions(screening.test, screening.model).collect():
        sums[r["pid"]] += r["value"]
    for r in screening.test.collect():
        t = r["topic_id"]
        want = priors[t] + sum(weights.get((t, w.lower()), 0) for w in toks(r["title"]) + toks(r["abstract"]))
        assert abs(logits[r["pid"]] - want) < 1e-4
        assert abs(logits[r["pid"]] - priors[t] - sums[r["pid"]]) < 1e-9


def test_topic_without_model_is_an_error(spark, screening):
    rows = spark.createDataFrame([("none", "1", "a", "b"), ("big", "2", "", "")],
                                 "topic_id string, pid string, title string, abstract string")
    got = {r["pid"]: r["verdict"] for r in judged(rows, screening.model).collect()}
    assert got["1"] == "Error" and got["2"] in ("Relevant", "Irrelevant")


def test_background_attributions_add_up(screening, brute):
    weights, _ = brute
    background = screening.train.collect()
    means = defaultdict(Counter)
    size = Counter()
    from tests.test_sampling import order

    for t in ("big", "tiny"):
        sample = sorted((r for r in background if r["topic_id"] == t), key=lambda r: order(r["pid"], "42:background"))[:30]
        size[t] = len(sample)
        for r in sample:
            means[t].update(w.lower() for w in toks(r["title"]) + toks(r["abstract"]))
    got = defaultdict(list)
    out = A.background_attributions(screening.test, screening.model, screening.train, n=30)
    for r in out.collect():
        got[r["pid"]].append(r)
    for r in screening.test.collect():
        t = r["topic_id"]
        f = sum(weights.get((t, w.lower()), 0) for w in toks(r["title"]) + toks(r["abstract"]))
        f_mean = sum(weights[t, w] * n / size[t] for w, n in means[t].items())
        assert abs(sum(x["value"] for x in got[r["pid"]]) - (f - f_mean)) < 1e-3
        assert sum(x["token"] is None for x in got[r["pid"]]) == 1


def test_save_and_load(spark, screening):
    path = new_dir(spark, "model")
    L.save_model(screening.model, path)
    both = L.load_model(spark, path)
    assert both.weights.df.count() == screening.model.weights.df.count()
    one = L.load_model(spark, path, "tiny")
    assert [r[0] for r in one.weights.df.select("topic_id").distinct().collect()] == ["tiny"]
    want = {r["pid"]: r["logit"] for r in screening.predictions().collect()}
    again = L.score(screening.test, both).collect()
    assert all(abs(want[r["pid"]] - r["logit"]) < 1e-9 for r in again)
    with pytest.raises(FileNotFoundError):
        L.load_model(spark, path + "-none")


def test_explained_records(screening):
    raw = explained(screening.test, screening.model)
    rec = {r["pid"]: r for r in raw.collect()}
    for r in screening.test.collect():
        assert rec[r["pid"]]["title_expl"]["tokens"] == toks(r["title"])
        assert rec[r["pid"]]["abstract_expl"]["tokens"] == toks(r["abstract"])
        assert all(a == -b for a, b in rec[r["pid"]]["title_expl"]["scores"])
    for r in readable(screening.test, screening.model).collect():
        low = [w["token"].lower() for w in r["top_words"]]
        assert len(set(low)) == len(low) <= 5 and all(re.search("[a-z]", w) for w in low)
        values = [w["value"] for w in r["top_words"]]
        assert values == sorted(values, reverse=r["verdict"] == "Relevant")


def test_nested_and_long_top_words_agree(screening):
    verdicts = screening.predictions().select("topic_id", "pid", L.verdict(F.col("prob")).alias("verdict"))
    long = A.attributions(screening.test, screening.model).join(verdicts, ["topic_id", "pid"])
    got = defaultdict(list)
    for r in sorted(A.top_words(long).collect(), key=lambda r: r["rank"]):
        got[r["pid"]].append((r["token"], r["value"]))
    nested = {r["pid"]: [tuple(w) for w in r["top_words"]] for r in readable(screening.test, screening.model).collect()}
    assert got == nested


def test_sampled_attributions(spark):
    texts = [("t", "1", "a b c d e f g h i j k"), ("t", "2", "one two"), ("t", "3", ""), ("t", "4", "x")]
    rows = spark.createDataFrame(texts, "topic_id string, pid string, text string")
    weights = {"a": 1.0, "c": -2.0, "k": 0.5, "one": 3.0, "x": 1.5}
    pairs = F.create_map(*[F.lit(v) for kv in weights.items() for v in kv])

    def additive(text):
        return F.aggregate(
            F.split(text, " "), F.lit(0.0), lambda acc, w: acc + F.coalesce(F.try_element_at(pairs, w), F.lit(0.0))
        )

    got = A.sampled_attributions(rows, additive, permutations=3, groups=4).collect()
    for r in got:  # an additive score gives every part its own tokens' weight in any order
        assert abs(r["value"] - sum(weights.get(t, 0) for t in r["tokens"])) < 1e-9
    assert Counter(r["pid"] for r in got) == {"1": 4, "2": 2, "4": 1}
    assert [t for r in sorted(got, key=lambda r: r["part"]) if r["pid"] == "1" for t in r["tokens"]] == list("abcdefghijk")

    square = lambda text: F.pow(F.size(F.filter(F.split(text, " "), lambda w: w != "")), 2.0)
    totals = defaultdict(float)
    for r in A.sampled_attributions(rows, square, permutations=2, groups=3).collect():
        totals[r["pid"]] += r["value"]
    assert totals == {"1": 121.0, "2": 4.0, "4": 1.0}


def halved(words, f, rounds, width):
    """The runs of a text and their values, by plain Python: {(lo, hi): value}."""
    n, say = len(words), lambda *parts: f(" ".join(w for p in parts for w in p))
    none, full = f(""), f(" ".join(words))
    runs = {(0, n): (full - none, full, none)}
    for _ in range(rounds):
        order = sorted((r for r in runs if r[1] - r[0] > 1), key=lambda r: (-round(abs(runs[r][0]), 9), r[0]))
        for lo, hi in order[:width]:
            value, alone, without = runs.pop((lo, hi))
            mid = (lo + hi) // 2
            a, b = say(words[lo:mid]), say(words[mid:hi])
            no_a, no_b = say(words[:lo], words[mid:]), say(words[:mid], words[hi:])
            x = ((a - none) + (alone - b) + (no_b - without) + (full - no_a)) / 4
            y = ((b - none) + (alone - a) + (no_a - without) + (full - no_b)) / 4
            runs[lo, mid], runs[mid, hi] = (x + (value - x - y) / 2, a, no_a), (y + (value - x - y) / 2, b, no_b)
    return {r: v[0] for r, v in runs.items()}


def test_values_of_runs_and_tokens(spark):
    draw = random.Random(6)
    weight = {w: draw.uniform(-2, 2) for w in WORDS}
    texts = [[draw.choice(WORDS) for _ in range(n)] for n in (1, 2, 3, 5, 8, 40)]
    rows = [("t", str(i), " ".join(w)) for i, w in enumerate(texts)] + [("t", "x", None), ("t", "y", " \n "), ("t", "1", " ".join(texts[1]))]
    df = spark.createDataFrame(rows, "topic_id string, pid string, text string")

    def clash(text):  # not additive: pairs of equal neighbours count, and the sum is squashed
        w = text.split()
        return math.tanh(sum(weight[x] for x in w) + sum(a == b for a, b in zip(w, w[1:])) + 0.25)

    plain = F.udf(clash, "double")
    for rounds, width in ((0, 1), (2, 1), (3, 2), (12, 64)):
        runs = A.run_attributions(df, plain, rounds, width)
        got = defaultdict(dict)
        for r in runs.collect():
            got[r["pid"]][r["lo"], r["hi"]] = r["value"]
            assert r["tokens"] == texts[int(r["pid"])][r["lo"] : r["hi"]]
        for i, w in enumerate(texts):
            want = halved(w, clash, rounds, width)
            assert got[str(i)].keys() == want.keys() and all(abs(got[str(i)][r] - v) < 1e-9 for r, v in want.items())
            assert abs(sum(want.values()) - (clash(" ".join(w)) - clash(""))) < 1e-9
        assert set(got) == {str(i) for i in range(len(texts))}
    values = defaultdict(list)  # the last rounds end at single tokens
    for r in A.token_values(runs).collect():
        values[r["pid"], r["pos"]].append((r["token"], r["value"]))
    assert len(values) == sum(map(len, texts)) and len(values["1", 0]) == 2  # the repeated row
    a, b = (clash(x) for x in texts[1])
    both, none = clash(" ".join(texts[1])), clash("")
    assert values["1", 0][0][1] == pytest.approx((a - none + both - b) / 2)  # the Shapley value
    summed = A.token_values(A.run_attributions(df, F.udf(lambda t: sum((weight[x] for x in t.split()), 0.0), "double"), 12, 64)).collect()
    assert all(abs(r["value"] - weight[r["token"]]) < 1e-9 for r in summed)


def test_truncation_closed_form(spark):
    pairs = [(a, b, r) for a in range(12) for b in range(12) for r in range(1, 15)]

    def by_steps(a, b, r):
        while a + b > r:
            if a > b:
                a -= 1
            else:
                b -= 1
        return a, b

    for room in range(1, 15):
        df = spark.createDataFrame([(a, b) for a, b, r in pairs if r == room], "a int, b int")
        keep = _keep_longest_first(F.col("a"), F.col("b"), room)
        for r in df.select("a", "b", keep[0].alias("ka"), keep[1].alias("kb")).collect():
            assert (r["ka"], r["kb"]) == by_steps(r["a"], r["b"], room)


def test_pair_encoding(spark):
    vocab = spark.createDataFrame([("a", 9, 4), ("b", 8, 5), ("c", 7, 6)], "token string, n int, token_id int")
    data = [
        ("t", "short", "A b", "c ?", 1), ("t", "long", "a b", "c c c c c c c c", 0), ("t", "none", "", None, 0),
        ("t", "title", "a a a a a a a a a", "b", 1),
    ]
    df = spark.createDataFrame(data, "topic_id string, pid string, title string, abstract string, relevance int")
    got = {r["pid"]: r for r in E.encode_pairs(df, vocab, 9).collect()}
    assert got["short"]["input_ids"] == [2, 4, 5, 3, 6, 1, 3, 0, 0]
    assert got["short"]["attention_mask"] == [1] * 7 + [0, 0]
    assert got["short"]["token_type_ids"] == [0, 0, 0, 0, 1, 1, 1, 0, 0]
    assert got["long"]["input_ids"] == [2, 4, 5, 3, 6, 6, 6, 6, 3]
    assert got["title"]["input_ids"] == [2, 4, 4, 4, 4, 4, 3, 5, 3]
    assert got["none"]["input_ids"] == [2, 3, 3] + [0] * 6
    assert got["short"]["label"] == 1.0
    single = {r["pid"]: r for r in E.encode_texts(df.withColumn("text", F.col("title")), vocab, 6).collect()}
    assert single["title"]["input_ids"] == [2, 4, 4, 4, 4, 3]
    assert single["none"]["input_ids"] == [2, 3, 0, 0, 0, 0]


def test_metrics(spark):
    data = [("t", "1", 0.5, 1), ("t", "2", 0.4, 1), ("t", "3", 0.9, 0), ("t", "4", 0.1, 0), ("u", "5", 0.2, 0)]
    df = spark.createDataFrame(data, "topic_id string, pid string, prob double, label int")
    got = {r["topic_id"]: r.asDict() for r in M.metrics_at(df, 0.5).collect()}
    assert (got["t"]["tp"], got["t"]["fp"], got["t"]["fn"], got["t"]["tn"]) == (1, 1, 1, 1)
    assert got["t"]["f1"] == 0.5 and got["u"]["precision"] == got["u"]["recall"] == got["u"]["f1"] == 0.0
    assert got["u"]["accuracy"] == 1.0
    sweep = M.threshold_sweep(df).filter("topic_id = 't'").orderBy("threshold").collect()
    assert [r["threshold"] for r in sweep] == [i / 10 for i in range(1, 10)]
    assert [r["tp"] + r["fp"] for r in sweep] == [4, 3, 3, 3, 2, 1, 1, 1, 1]


def test_losses(spark):
    df = spark.createDataFrame([(1.0, 1), (0.0, 1), (0.0, 0), (0.25, 1)], "prob double, label int")
    got = [r[0] for r in df.select(M.cross_entropy(2.0)).collect()]
    want = [0.0, -2 * math.log(1e-12), 0.0, -2 * math.log(0.25)]
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, want))
    batches = spark.createDataFrame([("t", 0, 1.0), ("t", 0, 3.0), ("t", 1, 8.0)], "topic_id string, batch_id int, loss double")
    assert tuple(M.mean_batch_loss(batches).first()) == ("t", 5.0, 2)


def test_linear_models_learn(screening):
    rows = screening.split.withColumn("text", F.concat_ws(" ", "title", "abstract")).withColumn("n", F.lit(1.0))
    for options in ({}, {"numeric": ["n"]}):
        fitted = L.train_linear(rows.filter("not is_test"), features=1 << 12, **options)
        out = L.score_linear(rows.filter("is_test"), fitted).collect()
        right = sum((r["prob"] >= 0.5) == (r["relevance"] == 1) for r in out)
        assert right / len(out) > 0.7


def test_offsets(spark):
    data = [("t", 0, i, [str(i)] * n, i % 2) for i, n in enumerate([2, 0, 3])]
    df = spark.createDataFrame(data, "topic_id string, batch_id int, row_in_batch int, tokens array<string>, relevance int")
    flat = E.flat_batches(E.batch_offsets(df, F.size("tokens"))).first()
    assert flat["offsets"] == [0, 2, 2] and flat["tokens"] == ["0", "0", "2", "2", "2"] and flat["labels"] == [0, 1, 0]


def test_terms_are_counted_in_the_row(spark):
    df = spark.createDataFrame([("1", list("abacab")), ("2", []), ("3", ["x"])], "pid string, w array<string>")
    got = sorted((tuple(r) for r in E.term_rows(df, F.col("w"), ["pid"]).collect()), key=str)
    assert got == [("1", "a", 3), ("1", "b", 2), ("1", "c", 1), ("2", None, None), ("3", "x", 1)]


def test_scores_do_not_depend_on_how_weights_are_joined(spark, screening):
    want = {r["pid"]: r["logit"] for r in screening.predictions().collect()}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        got = {r["pid"]: r["logit"] for r in screening.predictions().collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == want  # sums of whole units, so equal to the last bit
