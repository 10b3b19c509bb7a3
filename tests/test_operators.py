"""Operators on small inputs, against plain Python or known values."""

import random

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from paperloom.operators import analytics, dependencies, graph, learn, locate, patterns, positions, resolve, topics
from paperloom.operators.components import connected_components


def most_joined(spark, df):
    """Rows of ``df``, and the most rows that one of its joins gave."""
    rows = df.collect()
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs = store.executionsList()
    last = runs.apply(runs.size() - 1).executionId()
    values, nodes = store.executionMetrics(last), store.planGraph(last).allNodes()
    most = 0
    for node in (nodes.apply(i) for i in range(nodes.size())):
        for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
            if "Join" in node.name() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return rows, most


def test_components_of_random_graphs(spark):
    rng = random.Random(4)
    for n, m in ((1, 0), (40, 25), (60, 80)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(100, 120)]
        root = {v: v for e in edges for v in e}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        want = {v: find(v) for a, b in edges if a != b for v in (a, b)}
        got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == want


def test_snapshot_metrics(spark):
    edges = spark.createDataFrame([(1, 2, 1990), (1, 2, 1992), (2, 3, 1991), (4, 3, 1992), (3, 5, 1992)], "src int, dst int, year int")
    m = {(r.year, r.node): r for r in graph.node_metrics(edges, 1990, 1992, rounds=30).collect()}
    assert {k for k in m if k[0] == 1990} == {(1990, 1), (1990, 2)}
    assert m[1992, 3].in_degree == 2 and m[1991, 3].in_degree == 1
    assert abs(sum(r.pagerank for k, r in m.items() if k[0] == 1992) - 1) < 1e-9
    # 1 -> 2 -> 3 -> 5 and 4 -> 3: 3 carries 1-5, 2-5, 4-5; 2 carries 1-3, 1-5; of 4 * 3 ordered pairs
    assert abs(m[1992, 3].load_centrality - 3 / 12) < 1e-9 and abs(m[1992, 2].load_centrality - 2 / 12) < 1e-9


def test_resolution(spark):
    refs = spark.createDataFrame(
        [(1, "A", "a parser of trees", 2000, ["jo kim"]), (2, "A", "a parser of tree", 2001, ["jo kim"]), (3, "B", "deep nets", 2010, ["li wu"]), (4, "B", "deep nets!", 2010, ["li wu"]), (5, "B", "other", 1999, ["x y"])],
        "ref_id long, citing string, title string, year int, authors array<string>",
    )
    papers = spark.createDataFrame([("P00-1", "a parser of trees", 2000, ["joan kim"]), ("Q1", "something", 1990, ["z"])], "paper_id string, title string, year int, authors array<string>")
    edges = spark.createDataFrame([("B", "Q1")], "citing string, cited string")
    got = {r.ref_id: r.paper_id for r in resolve.resolve(refs, edges, papers).collect()}
    assert got[1] == got[2] == "P00-1" and got[3] == got[4] != got[5]
    assert {got[3], got[5]} == {"External_0", "External_1"}


def test_blocks_lose_nothing(spark):
    rng = random.Random(1)
    titles = ["".join(rng.choice("ab ") for _ in range(rng.randrange(1, 7))).strip() or "a" for _ in range(60)]
    rows = [(i, t, 2000, ["k"]) for i, t in enumerate(titles)]
    refs = spark.createDataFrame(rows[:30], "ref_id long, title string, year int, authors array<string>")
    papers = spark.createDataFrame([(f"{i:03}", *r) for i, *r in rows[30:]], "paper_id string, title string, year int, authors array<string>")

    def share(a, b):
        a, b = a.replace(" ", ""), b.replace(" ", "")
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return max(n / len(a), n / len(b))

    want = {i: next((f"{j:03}" for j, u, *_ in rows[30:] if share(t, u) > 0.9), None) for i, t, *_ in rows[:30]}
    got = {r.ref_id: r.paper_id for r in resolve.fuzzy_known(refs, papers).collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_copies_are_resolved_once(spark, monkeypatch):
    """Classes equal those of a brute force over all references, while only different texts are paired."""
    rng = random.Random(4)
    titles = ["".join(rng.choice("ab ") for _ in range(rng.randrange(3, 14))) for _ in range(25)] + ["", " ", None]
    rows = [(i, rng.choice(titles), 2000 + i % 3, rng.choice([["a kim"], ["b ott"], None])) for i in range(400)]
    refs = spark.createDataFrame(rows, "ref_id long, title string, year int, authors array<string>")
    seen, inner = [], resolve.fuzzy_pairs
    monkeypatch.setattr(resolve, "fuzzy_pairs", lambda df, *a: seen.append(df.count()) or inner(df, *a))
    got = {r.ref_id: r.paper_id for r in resolve.resolve(refs.withColumn("citing", F.lit("c")), spark.createDataFrame([], "citing string, cited string"), spark.createDataFrame([], "paper_id string, title string, year int, authors array<string>")).collect()}

    def linked(x, y):
        a, b = (x[1] or "").replace(" ", ""), (y[1] or "").replace(" ", "")
        n = next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
        return bool(a and b) and x[1][:3] == y[1][:3] and x[3] is not None and x[3] == y[3] and n / min(len(a), len(b)) > 0.9

    root = {r[0]: r[0] for r in rows}
    changed = True
    while changed:
        changed = False
        for x in rows:
            least = min(root[y[0]] for y in rows if y is x or linked(x, y))
            changed |= least != root[x[0]]
            root[x[0]] = least
    order = {k: f"External_{n}" for n, k in enumerate(sorted(set(root.values())))}
    assert got == {k: order[v] for k, v in root.items()}
    assert seen == [len({(r[1], r[3][0]) for r in rows if (r[1] or "").strip() and r[3]})]


def test_nearest_meets_no_pairs(spark):
    """The nearest point of a group equals brute force, over ties, edges of cells, copies and odd values, and no join gives more than the rows."""
    rng = random.Random(6)
    odd = [float("nan"), float("inf"), -0.0, 0.0, 511.5, 512.0, -1e-13, 500.0, 1e300, None]
    rows = [(i, i % 3, rng.choice([*odd, *(rng.randrange(-4000, 4000) / 4 for _ in range(20))])) for i in range(300)] + [(7, 1, 3.25)]
    points = [(i, i % 4, rng.choice([*odd, *(rng.randrange(-4000, 4000) / 4 for _ in range(20))])) for i in range(300)]
    best = {}
    for i, g, v in rows:
        hits = [(abs(w - v), k) for k, h, w in points if g == h and v is not None and w is not None and abs(w - v) <= 500]
        if hits:
            best[i] = min([*hits, *([best[i]] if i in best else [])])
    got, most = most_joined(spark, locate.nearest(spark.createDataFrame(rows, "id long, grp int, v double"), spark.createDataFrame(points, "key long, grp int, v double"), 500.0))
    assert len(got) == len(best) and {r.id: r.key for r in got} == {i: k for i, (_, k) in best.items()}
    assert 0 < most <= len(rows)


def test_bootstrap_sums_weights_where_they_are_drawn(spark):
    """Means and ends equal those of weights drawn row by row; rows times draws are never a table."""
    import numpy as np

    rows = [([None, "a", "b", f"g{i}"][i % 4], i, None if i % 11 == 0 else i * 0.5) for i in range(1200)]
    df = spark.createDataFrame(rows, "g string, id long, v double").repartition(3)
    out = analytics.bootstrap_mean(df, ["g"], "v", draws=40)
    got = {r.g: r for r in out.collect()}
    hashes = {r.id: r.h for r in df.select("id", F.xxhash64(*df.columns).alias("h")).collect()}
    for g in ("a", "b"):
        own = [(hashes[i], v) for k, i, v in rows if k == g and v is not None]
        w = np.array([np.random.default_rng([3, h & 0x7FFFFFFFFFFFFFFF]).poisson(1.0, 40) for h, _ in own])
        means = sorted((w * np.array([v for _, v in own])[:, None]).sum(axis=0) / w.sum(axis=0))
        assert abs(got[g]["low"] - means[1]) < 1e-9 and abs(got[g]["high"] - means[39]) < 1e-9
        assert abs(got[g]["mean"] - sum(v for _, v in own) / len(own)) < 1e-9
    assert set(got) >= {"a", "b", "g3"} and None not in got
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan


def test_document_topics_hold_no_matrix(spark, monkeypatch):
    """Documents of two vocabularies fall apart, parts and summed additions change nothing, and the model is never fitted on the driver."""
    import numpy as np

    monkeypatch.setattr(topics, "LDA", None)
    monkeypatch.setattr(topics, "CountVectorizer", None)
    x = np.array([0.01, 0.5, 1.0, 7.0, 300.0])
    h = 1e-5
    assert abs(topics._digamma(np.array([1.0]))[0] + 0.5772156649015329) < 1e-9
    assert np.allclose(topics._trigamma(x[1:]), (topics._digamma(x[1:] + h) - topics._digamma(x[1:] - h)) / (2 * h), rtol=1e-4)
    rng = random.Random(2)
    rows = [(f"{i}", [f"{'ab'[i % 2]}{rng.randrange(12)}" for _ in range(rng.randrange(20, 30))]) for i in range(80)] + [("none", [])]
    docs = spark.createDataFrame(rows, "id string, words array<string>").repartition(3)
    got = {}
    for part in (100_000, 300):
        got[part] = {r.id: r.topics for r in topics.document_topics(docs, topics=2, rounds=10, rate=0.6, words_a_part=part).collect()}
    one, many = got.values()
    assert one.keys() == many.keys() == {r[0] for r in rows} and one["none"] == [0.0, 0.0]
    assert all(max(abs(p - q) for p, q in zip(one[i], many[i])) < 0.01 for i in one)
    assert all(abs(sum(v) - 1) < 1e-9 for i, v in one.items() if i != "none")
    side = {p: {max((0, 1), key=lambda k: one[str(i)][k]) for i in range(p, 80, 2)} for p in (0, 1)}
    assert len(side[0]) == len(side[1]) == 1 and side[0] != side[1]


def test_copies_in_networks_are_compared_once(spark):
    """Titles that a network has many times do not meet each other as pairs of copies."""
    names = ["large ring", "Ring!", "hot bolt", "", None]
    refs = [(i, "AB"[i % 2], ["ring", "a hot bolt", "none", "", None][i % 5]) for i in range(200)]
    papers = [(f"K{i:03}", names[i % 5]) for i in range(200)]
    edges = [("AB"[i // 100], f"K{i:03}") for i in range(200)]
    clean = lambda t: (t or "").lower().replace("!", "")
    want = {}
    for i, c, t in refs:
        hits = [k for (d, k), (_, n) in zip(edges, papers) if d == c and clean(t) and clean(n) and (clean(t) in clean(n) or clean(n) in clean(t))]
        if hits:
            want[i] = min(hits)
    got, most = most_joined(spark, resolve.in_network(*(spark.createDataFrame(rows, s) for rows, s in ((refs, "ref_id long, citing string, title string"), (edges, "citing string, cited string"), (papers, "paper_id string, title string")))))
    assert {r.ref_id: r.paper_id for r in got} == want
    assert 0 < most <= 200  # 40 copies of a title times 20 of another before


def test_authors(spark):
    rows = [(["a kim", "b lee"], ["x lee", "y kim"], True), (["a kim"], ["kim a"], True), (["a kim"], ["a kin"], True), (["a kim"], ["b ott"], False), (["a kim"], ["a kim", "b"], False), (["a", "b", "c", "d"], ["a", "b", "c", "zz"], True)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>, want boolean")
    assert all(r[0] == r[1] for r in df.select(resolve.authors_agree("a", "b"), "want").collect())


def test_reference_letters(spark):
    refs = spark.createDataFrame([("d", 1, 0, ["Kim"], 1998), ("d", 2, 1, ["Kim"], 1998), ("d", 3, 2, ["Lee", "Wu", "Ott"], 2001)], "doc string, ref_id int, pos int, surnames array<string>, year int")
    cites = spark.createDataFrame([("d", "c1", "Kim 1998a"), ("d", "c2", "Kim 1998b"), ("d", "c3", "Lee et al. 2001"), ("d", "c4", "Kim 1998"), ("d", "c5", "Nobody 1998")], "doc string, cite_id string, cite string")
    got = {r.cite_id: r.ref_id for r in resolve.find_reference(cites, refs).collect()}
    assert got == {"c1": 1, "c2": 2, "c3": 3, "c4": 2}


def test_locate_with_rewrites(spark):
    ctx = spark.createDataFrame([(0, "p", "Kim et al 2000", "as shown by Kim et al. 2000 here"), (1, "p", "Lee", "nothing"), (2, "p", "Ott 1999", "see Ott , 1999")], "ctx int, paper_id string, cite string, context string")
    sents = spark.createDataFrame([("p", 0, 0, 0, "intro"), ("p", 0, 0, 1, "as shown by Kim et al. 2000 here"), ("p", 1, 0, 0, "Kim et al. 2000 again"), ("p", 1, 0, 1, "see Ott , 1999")], "paper_id string, section int, subsection int, sentence int, text string")
    got = {r.ctx: (r.section, r.sentence, r.citation_id) for r in locate.locate(ctx, sents).collect()}
    assert got == {0: (0, 1, "p_0"), 2: (1, 1, "p_1")}


def sentence(*words):
    return [dict(zip(("word", "lemma", "pos", "ArgType"), w)) for w in words]


def test_pattern_language():
    t = patterns.Tables.of(concepts={"SELF": "we, our own", "WORK": "new model, model"}, actions={"USE": "use"}, formulaic={"F": "@USE the @WORK, #J @WORK"}, agents={"US": "@SELF"})
    s = sentence(("We", "we", "PRP", "subj"), ("use", "use", "VBP", "verb"), ("the", "the", "DT", None), ("new", "new", "JJ", None), ("model", "model", "NN", "dobj"), ("CITATION", "citation", "NN", None))
    assert patterns.find(t, ("@USE", "the", "@WORK"), s) == 1
    assert patterns.find(t, ("#J", "@WORK"), s) == 3
    assert patterns.find(t, ("CITATION",), s) == 5 and patterns.find(t, ("SELFCITATION",), s) == -1
    assert patterns.pattern_features(t, s, 5) == {"F": 1 - 3 - 5, "US": 0 - 1 - 5}
    assert patterns.lexicon_features(t.concepts, s, 5) == {"SELF": -5, "WORK": -2}
    with pytest.raises(KeyError):
        patterns.find(t, ("@NONE",), s)
    assert patterns.contrasts(patterns.DEFAULT, sentence(("In", "in", "", None), ("contrast", "contrast", "", None)))


def test_places_of_patterns(spark, monkeypatch):
    """Features of a batch equal those of a search at every place, and only places where something may begin are looked at."""
    rng = random.Random(8)
    tables = patterns.Tables.of(
        concepts={"SELF": "we, our own", "WORK": "new model, model, we model"},
        actions={"USE": "use, make use"},
        formulaic={"F": "@USE the @WORK, #J @WORK, the", "G": "CREF @SELF", "CONTRAST_FORMULAIC": "however, in CITATION", "COMPARISON_FORMULAIC": "like SELFCITATION"},
        agents={"US_AGENT": "@SELF, CITATION", "THEM_AGENT": "the @WORK, SELFCITATION"},
    )
    words = ["we", "our", "own", "new", "model", "use", "make", "the", "however", "in", "contrast", "like", "CITATION", "SELFCITATION", "CREF", "x", None]
    token = lambda: (w := rng.choice(words[:-1]), rng.choice([w.lower(), rng.choice(words)]), rng.choice(["VB", "VBN", "JJ", "CD", "", None]), rng.choice(["subj", None]))
    rows = [(i, [token() for _ in range(rng.randrange(0, 9))] if i % 20 else None, rng.choice([0, 3, None])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, tokens array<struct<word string, lemma string, pos string, ArgType string>>, cite_index int")
    for t in (tables, patterns.DEFAULT):
        got = {r.id: r.features for r in patterns.sentence_features(df.repartition(3), t).collect()}
        for i, s, c in rows:
            s, c = sentence(*(s or [])), c or 0
            assert got[i] == {**patterns.pattern_features(t, s, c), **patterns.lexicon_features(t.concepts, s, c), **patterns.lexicon_features(t.actions, s, c, "V"), "contrast": int(patterns.contrasts(t, s)), "compare": int(patterns.compares(t, s))}
    looked, inner = [], patterns.in_lexicon
    monkeypatch.setattr(patterns, "in_lexicon", lambda *a, **k: looked.append(a[2]) or inner(*a, **k))
    plain = spark.createDataFrame([(" ".join(["word"] * 500 + ["we"] + ["word"] * 500),)], "text string").select(patterns.plain_tokens(F.col("text")).alias("tokens")).toArrow()
    (s, places), = patterns.Starts(patterns.DEFAULT).sentences(plain.column(0).combine_chunks())
    assert patterns.pattern_features(patterns.DEFAULT, s, 0, places=places) == {"US_AGENT_AS_FORMULAIC": 500} and set(looked) == {500}


def test_windows(spark):
    df = spark.createDataFrame([("p", i, h) for i, h in enumerate([0, 0, 0, 1, 0, 0])], "p string, i int, h int")
    got = [r.distance for r in positions.first_hit(df, ["p"], "i", F.col("h") == 1).orderBy("i").collect()]
    assert got == [3, 2, 1, 100, 100, 100]
    ewm = [r.ewm for r in positions.smoothed(df, ["p"], "i", "h", 1).orderBy("i").collect()]
    assert ewm == [0, 0, 0, 1, 0, 0]
    v = spark.range(1).select(positions.upper_median(F.array(*map(F.lit, (4, 1, 3, 2)))), positions.index_percentile(F.array(*map(F.lit, range(20))), 19, 20)).first()
    assert tuple(v) == (3, 19)


def test_as_of_and_prefix(spark):
    facts = spark.createDataFrame([("a", 1999), ("a", 2003), ("b", 2000)], "k string, y int")
    metrics = spark.createDataFrame([("a", 2000, 5), ("a", 2002, 7)], "k string, y int, v int")
    assert {(r.k, r.y): r.v for r in locate.at_year(facts, metrics, ["k"], "y", ["v"], as_of=True).collect()} == {("a", 1999): None, ("a", 2003): 7, ("b", 2000): None}
    ids = spark.createDataFrame([("W05-01",), ("W06-99",), ("X",)], "id string")
    table = spark.createDataFrame([("W05-01", "w1"), ("W05", "w2"), ("W06", "w3")], "prefix string, value string")
    assert {r.id: r.value for r in locate.longest_prefix(ids, table).collect()} == {"W05-01": "w1", "W06-99": "w3", "X": None}


def test_paths_and_clauses(spark):
    deps = spark.createDataFrame([(0, "ROOT", 0, 2), (0, "nsubj", 2, 1), (0, "dobj", 2, 3), (0, "punct", 2, 4)], "sid int, dep string, gov int, tok int")
    lem = spark.createDataFrame([(0, 1, "we"), (0, 2, "use"), (0, 3, "it"), (0, 4, ".")], "sid int, tok int, lemma string")
    got = {(r.path, r.leaf) for r in dependencies.paths(deps, lem, spark.createDataFrame([(0, 3)], "sid int, origin int")).collect()}
    assert got == {("inv-dobj", "use"), ("inv-dobj nsubj", "we")}
    s = spark.createDataFrame([([("V",), ("N",), ("V",), ("N",)], [("ROOT", 0, 1), ("dobj", 1, 2), ("advcl", 1, 3), ("dobj", 3, 4)])], "tokens array<struct<pos: string>>, deps array<struct<dep: string, governor: int, dependent: int>>")
    assert [tuple(x) for x in dependencies.clauses(s).first().spans] == [(0, 1), (0, 1), (2, 3), (2, 3)]


def test_selectional_preference_leaves_own_file_out(spark):
    gold = spark.createDataFrame([("f", "Uses", "dobj", "x"), ("g", "Uses", "dobj", "y"), ("g", "Uses", "punct", "x")], "file_id string, label string, path string, leaf string")
    words = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "word string, vector array<double>")
    here = spark.createDataFrame([("f", 0, "dobj", "x"), ("h", 0, "dobj", "x")], "file_id string, sid int, path string, leaf string")
    got = {r.file_id: r.sim for r in dependencies.selectional_preference(gold, words, here).collect()}
    assert got["f"] == 0 and abs(got["h"] - 0.5**0.5) < 1e-9


def test_learning(spark):
    rng = random.Random(2)
    rows = [(f"p{i % 10}", "a" if i % 4 else "b", {"x": rng.gauss(0 if i % 4 else 3, 1), "y": rng.random()}) for i in range(200)]
    df = spark.createDataFrame(rows, "paper string, label string, features map<string,double>")
    names = learn.feature_names(df)
    assert names == ["x", "y"]
    x = learn.vectorise(df, names)
    cv = learn.cross_validate(x, "label", "paper", folds=2, trees=5, leaf=2, share="all")
    s = learn.summary(cv).first()
    assert cv.count() == 200 and s.micro_f1 > 0.8 and s.macro_f1 > 0.75
    w = {r.label: r.weight for r in learn.class_weights(df, "label").collect()}
    assert w == {"a": 200 / (2 * 150), "b": 2.0}
    made = learn.smote(df.select("label", F.monotonically_increasing_id().alias("k"), F.array(F.col("features")["x"], F.col("features")["y"]).alias("v")), "label", "v", "k")
    assert made.count() == 100 and made.where("label <> 'b'").isEmpty()
    assert array_to_vector is not None


def test_statistics(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + 1 + (50 if i == 7 else 0)) for i in range(30)], "x double, y double")
    slope, cut = analytics.robust_trend(df, "x", "y")
    assert abs(slope - 2) < 0.05 and abs(cut - 1) < 0.5
    assert analytics.drop_collinear(df.withColumn("z", F.col("x") * 2).withColumn("u", F.pmod(F.hash("x"), F.lit(7)).cast("double")).drop("y"), ["x", "z", "u"]) in (["z", "u"], ["x", "u"])
    n = spark.createDataFrame([("d", "a", 90), ("d", "b", 10)], "d string, t string, n long")
    got = {r.t: r for r in analytics.bootstrap_shares(n, ["d"], "t", draws=400).collect()}
    assert got["a"].low < 0.9 < got["a"].high + 0.02 and abs(got["a"].mid - 0.9) < 0.03


def test_scrub(spark):
    from paperloom.functions import text as tx

    texts = ["kim et al. 1999 , said ; \u00e9 -lrb- x -rrb- 2001 1999 y.", "a alx b al c et d", "semi; stays"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], ["t"]).select(tx.scrub(F.col("t"))).collect()]
    assert got == ["kim al  said ;   x  1999 y", "a b c d", "semi; stays"]


def test_name_clusters(spark):
    names = ["Workshop on Machine Translation", "Workshop on Machine Translations", "Workshop on Parsing", "Parsing Workshop on"]
    got = {r.name: r.cluster for r in resolve.greedy_name_clusters(spark.createDataFrame([(n,) for n in names], ["name"])).collect()}
    assert got == {names[0]: names[0], names[1]: names[0], names[2]: names[2], names[3]: names[3]}


def test_trim_keeps_rows(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "x"]), (1, ["a", "b", "x"]), (1, ["b", "c", "once"]), (2, ["once2"]), (3, [])], "id int, words array<string>")
    got = sorted((r.id, r.words) for r in topics.trim(docs, common=1, least=2).collect())
    assert got == [(1, ["DUMMY"]), (1, ["a", "x"]), (1, ["a", "x"]), (2, ["DUMMY"]), (3, ["DUMMY"])]
    model = topics.fit_topics(docs.where("size(words) > 0"), topics=2, rounds=2)
    assert len(model.stages[0].vocabulary) == 6 and all(len(r.words) == 3 for r in topics.top_words(model, 3).collect())


def test_append_needs_its_key(spark, tmp_path):
    from paperloom.sources import sinks

    path = str(tmp_path / "t")
    sinks.append_new(spark.createDataFrame([(1, "a")], "k int, v string"), path, "k")
    sinks.append_new(spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string"), path, "k")
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]
    with pytest.raises(Exception):
        sinks.append_new(spark.createDataFrame([(1, 2)], "z int, v int"), path, "z")
