"""The worked example of predicate paths, normal forms, stems and evaluation."""

import random

from lexiloom import cli
from lexiloom.functions.stem import stem, stem_word
from lexiloom.operators import evaluation, mi, ngrams, path_mi, similarity, templates
from lexiloom.plans.catalogue import QUERIES
from lexiloom.sources import tables

LINES = """causes\tsmoking/NN/nsubj/2 causes/VBZ/ROOT/0 cancer/NN/dobj/2\t10\t1999,10
causes\tvirus/NN/nsubj/2 causes/VBZ/ROOT/0 disease/NN/dobj/2\t4
produces\tsmoking/NN/nsubj/2 produces/VBZ/ROOT/0 cancer/NN/dobj/2\t6
produces\tvirus/NN/nsubj/2 produces/VBZ/ROOT/0 fever/NN/dobj/2\t5
confused\tdogs/NNS/nsubjpass/2 confused/VBN/ROOT/0 with/IN/prep/2 cats/NNS/pobj/3\t3
resulted\tcancer/NN/nsubj/2 resulted/VBD/ROOT/0 smoking/NN/prep_from/2\t7
was\tdog/NN/nsubj/2 was/VBD/ROOT/0 friend/NN/attr/2\t9
ate\tthe/DT/det/2 dog/NN/poss/3 cat/NN/nsubj/4 ate/VBD/ROOT/0 1/2/CD/num/6 fish/NN/dobj/4\t2
bad\tdog/NN/nsubj ate/VBD/ROOT/0\t2
bad\tdog/NN/nsubj/2  ate/VBD/ROOT/0 cat/NN/dobj/2\t2
bad\tdog/NN/nsubj/2 ate/VBD/ROOT/0 cat/NN/dobj/2\tx1""".split("\n")
PAIRS = [("X cause Y", "X produces Y", 1), ("X cause Y", "Y result from X", 1), ("X confuse with Y", "X cause Y", 1), ("X cause Y", "X result from Y", 0), ("X eat Y", "X produce Y", 0)]


def lines(spark):
    return spark.createDataFrame([(x,) for x in LINES], "value string")


def pairs(spark):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(PAIRS)], "ord bigint, lhs string, rhs string, label int")


def test_worked_example(spark):
    table = mi.mutual_information(ngrams.triples(ngrams.parse(lines(spark)))).collect()
    got = {(r.pid, r.slot, r.word): (round(r.mi, 6), r.cnt) for r in table}
    assert len(got) == 14
    assert got["X caus Y", "X", "smoke"] == (0.501857, 10)
    assert got["X confus with Y", "Y", "cat"] == (2.512306, 3)
    assert got["X produc Y", "Y", "fever"] == (1.213023, 5)
    assert got["X at Y", "Y", "fish"] == (2.917771, 2)


def test_stored_marginals_are_scanned_alone(spark, tmp_path):
    triples = ngrams.triples(lines(spark))
    mi.store(triples, str(tmp_path / "m"))
    got = mi.of_stored(spark, str(tmp_path / "m"))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(got.collect()) == sorted(mi.mutual_information(triples).collect())
    listed = spark.createDataFrame([("X caus Y",), ("X no Y",)], "pid string")
    assert sorted(mi.of_stored(spark, str(tmp_path / "m"), listed).collect()) == sorted(mi.mutual_information(triples, listed).collect())


def test_scores_and_evaluation(spark):
    table = mi.mutual_information(ngrams.triples(ngrams.parse(lines(spark)))).cache()
    scores = similarity.path_similarity(table, pairs(spark)).cache()
    assert [round(r.score, 6) for r in scores.orderBy("ord").collect()] == [0.501477, 0.801646, 0, 0, 0]
    best = similarity.path_similarity(table, pairs(spark), use_max_swap=True)
    assert [round(r.score, 6) for r in best.orderBy("ord").collect()] == [0.501477, 0.801646, 0, 0.801646, 0]
    r = evaluation.best_threshold(scores).first()
    assert (round(r.threshold, 6), round(r.f1, 6), r.tp, r.fp, r.fn, r.tn) == (0.501477, 0.8, 2, 0, 1, 2)
    curve = [(round(x.threshold, 6), round(x.precision, 6), round(x.recall, 6)) for x in evaluation.pr_curve(scores).orderBy("threshold").collect()]
    assert curve == [(0, 0.6, 1), (0.501477, 1, 0.666667), (0.801646, 1, 0.333333)]
    none = evaluation.best_threshold(scores.limit(0)).first()
    assert none.threshold != none.threshold and none.f1 == 0
    z = evaluation.zero_breakdown(table, pairs(spark)).first()
    assert (z.zero_positives, z.missing_1, z.apart_x, z.apart_y) == (1, 0, 1, 1)


def test_normal_forms(spark):
    texts = ["  Y  Result from X ", "X Y foo", "x be affected by y", "foo", "X runs fast", ""]
    rows = {r.template: (r.pid, r.swapped, r.logical) for r in templates.normalize(spark.createDataFrame([(t,) for t in texts], "template string")).collect()}
    assert rows["  Y  Result from X "] == ("X result from Y", True, "Y result from X")
    assert rows["X Y foo"] == ("X y Y", False, "X y Y")
    assert rows["x be affected by y"][0] == "X be affected by Y"
    assert rows["foo"] == ("foo", False, "foo") and rows["X runs fast"][0] == "x runs fast" and rows[""] == ("", False, "")


def test_stems(spark):
    known = dict(cause="caus", results="result", confused="confus", produce="produc", associated="associ", involving="involv", relieves="reliev", treatment="treatment", reduces="reduc", ies="i", yying="yy", disease="diseas", diabetes="diabet", hopping="hop", falling="fall", relational="relat", sky="sky", happy="happi", be="be", controlling="control", rate="rate", hoping="hope", agreed="agre", adoption="adopt")
    known["is"] = "is"
    got = {r.word: r.stem for r in stem(spark.createDataFrame([(w,) for w in known], "word string")).collect()}
    assert got == known


def chain(heads, i):
    out, n = [i], len(heads)
    for _ in range(n):
        p = heads[out[-1]]
        p = -1 if p < 1 or p > n or p - 1 == out[-1] else p - 1
        if p < 0:
            break
        out.append(p)
    return out


def test_common_ancestors_of_random_trees(spark):
    rule = random.Random(5)
    trees = [[rule.randrange(-1, 8) for _ in range(rule.randrange(2, 7))] for _ in range(300)]
    rows = spark.createDataFrame([(" ".join(f"w{i}/NN/x/{h}" for i, h in enumerate(t)), n) for n, t in enumerate(trees)], "t string, n int").selectExpr("concat('h\\t', t, '\\t', n) as value")
    got = {(r.cnt, r.i, r.j): r.lca for r in ngrams.common_ancestors(ngrams.parse(rows)).collect()}
    want = {}
    for n, t in enumerate(trees):
        for j in range(len(t)):
            for i in range(j):
                want[n, i, j] = next((x for x in chain(t, j) if x in chain(t, i)), None)
    assert got == want


def test_command_line(spark, tmp_path):
    (tmp_path / "in.txt").write_text("\n".join(LINES))
    for name, label in (("pos", 1), ("neg", 0)):
        (tmp_path / f"{name}.txt").write_text("\n".join(f"{a}\t{b}" for a, b, y in PAIRS if y == label))
    t = str(tmp_path)
    assert cli.run(spark, ["extract-triples", "--input", f"{t}/in.txt", "--output", f"{t}/triples"]) == 0
    assert cli.run(spark, ["global-counts", "--input", f"{t}/triples", "--output", f"{t}/counts"]) == 0
    assert cli.run(spark, ["compute-mi", "--triples", f"{t}/triples", "--output", f"{t}/mi"]) == 0
    assert cli.run(spark, ["store-triples", "--triples", f"{t}/triples", "--output", f"{t}/stored"]) == 0
    assert cli.run(spark, ["compute-mi", "--stored", f"{t}/stored", "--output", f"{t}/mi2"]) == 0 and cli.run(spark, ["compute-mi", "--output", "x"]) == 2
    assert sorted(spark.read.text(f"{t}/mi2").collect()) == sorted(spark.read.text(f"{t}/mi").collect())
    assert cli.run(spark, ["make-test-path-list", "--pos", f"{t}/pos.txt", "--neg", f"{t}/neg.txt", "--output", f"{t}/paths"]) == 0
    assert cli.run(spark, ["filter-mi", "--mi", f"{t}/mi", "--paths", f"{t}/paths", "--output", f"{t}/few"]) == 0
    assert cli.run(spark, ["score-eval", "--mi", f"{t}/few", "--pos", f"{t}/pos.txt", "--neg", f"{t}/neg.txt", "--out", f"{t}/eval"]) == 0
    assert [r[5] for r in spark.read.csv(f"{t}/eval/scores", sep="\t", header=True).collect()][:2] == ["0.501477", "0.801646"]
    bare = ["score-eval", "--useMaxSwap", "--mi", f"{t}/few", "--pos", f"{t}/pos.txt", "--neg", f"{t}/neg.txt", "--unknown", "x", "--output", f"{t}/swapped"]
    assert cli.run(spark, bare) == 0
    assert [r[5] for r in spark.read.csv(f"{t}/swapped/scores", sep="\t", header=True).collect()][3] == "0.801646"
    assert cli.run(spark, ["no-such-command"]) == cli.run(spark, []) == cli.run(spark, ["filter-mi", "--mi", "x"]) == 2


def test_options():
    assert cli.options(["x", "--a", "1", "2", "--b", "--c", "--a", "3"]) == {"a": "3", "b": "true", "c": "true"}
    a = cli.arguments(["extract-triples", "--input", "i", "--output", "o", "--stemAll", "False"])
    assert (a.stemAll, a.filterAux, a.exclude) == ("False", "true", None)


def test_sweep_of_any_scores(spark, many_ranges):
    rule = random.Random(8)
    scores = [(rule.choice([rule.random(), rule.random() * 3 - 1, round(rule.random(), 2), 0.0, 1.0, float("nan")]), rule.randrange(2)) for _ in range(400)]
    got = evaluation.sweep(spark.createDataFrame(scores, "score double, label int")).collect()
    key = lambda s: (s != s, s if s == s else 0)
    want = {}
    for at in {key(s) for s, _ in scores}:
        above = [y for s, y in scores if key(s) >= at]
        want[at] = (sum(above), len(above) - sum(above))
    assert {key(r.threshold): (r.tp, r.fp) for r in got} == want and len(got) == len(want)


def test_last_of_repeated_rows_by_place_in_the_file(spark, tmp_path):
    text = "".join(f"X v Y\tX\tw{i % 50}\t{i + 1}.5\t1\n" for i in range(4000))
    (tmp_path / "mi.txt").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    rows = tables.read_mi(spark, str(tmp_path / "mi.txt"))
    assert rows.rdd.getNumPartitions() > 2
    got = {r.word: r.mi for r in similarity.vectors(rows).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {f"w{i % 50}": i + 1.5 for i in range(3950, 4000)}


def test_lines_are_numbered_by_many_tasks(spark, tmp_path):
    text = {name: [f"{name} {i} " + "x" * (i % 37) for i in range(n)] for name, n in (("b.txt", 3000), ("a.txt", 1), ("c.txt", 500))}
    for name, own in text.items():
        (tmp_path / name).write_bytes((b"\r\n" if name == "c.txt" else b"\n").join(x.encode() for x in own))
    (tmp_path / "d.txt").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    rows = tables.numbered_lines(spark, str(tmp_path))
    assert tables.text_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 10
    got = sorted((r.ord, r.line, r.value) for r in rows.collect())
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(n, i, x) for n, (i, x) in enumerate((i, x) for name in sorted(text) for i, x in enumerate(text[name]))]


def test_command_line_of_earlier_scores_and_jobs(spark, tmp_path):
    t = str(tmp_path)
    (tmp_path / "in.txt").write_text("\n".join(LINES))
    (tmp_path / "out.txt").write_text("\n".join(LINES))
    for name, label in (("pos", 1), ("neg", 0)):
        (tmp_path / f"{name}.txt").write_text("\n".join(f"{a}\t{b}" for a, b, y in PAIRS if y == label))
    assert cli.run(spark, ["extract-triples", "--input", f"{t}/in.txt, {t}/out.txt,", "--exclude", f"{t}/out.txt", "--output", f"{t}/triples"]) == 0
    assert {tuple(r) for r in tables.read_triples(spark, f"{t}/triples").collect()} == {tuple(r) for r in ngrams.triples(ngrams.parse(lines(spark))).collect()}
    assert cli.run(spark, ["compute-mi", "--triples", f"{t}/triples", "--output", f"{t}/mi"]) == 0
    (tmp_path / "earlier.txt").write_text("lhs\trhs\tlabel\tn1\tn2\tscore\nX cause Y\tX produces Y\t1\ta\tb\t0.25\nX cause Y\tX produces Y\t1\ta\tb\t0.75\nbad\n")
    assert cli.run(spark, ["score-eval", "--mi", f"{t}/mi", "--pos", f"{t}/pos.txt", "--neg", f"{t}/neg.txt", "--out", f"{t}/eval", "--compareWith", f"{t}/earlier.txt"]) == 0
    errors = {(r[1], r[2]): r[5] for r in spark.read.csv(f"{t}/eval/errors", sep="\t", header=True).collect()}
    assert errors["X cause Y", "X produces Y"] == "0.750000" and errors["X cause Y", "Y result from X"] == "NA"
    (tmp_path / "tasks.txt").write_text("POS\thttps://example.com/a.txt\nbad\nPOS\thttps://example.com/b.txt\n")
    assert cli.run(spark, ["submit", "--input", f"{t}/tasks.txt", "--taskId", "j", "--output", f"{t}/tasks"]) == 0
    assert sorted(r.sub_task_id for r in spark.read.parquet(f"{t}/tasks").collect()) == ["j:0", "j:1"]
    done = spark.createDataFrame([("j", f"j:{n}", n, "SUCCEEDED", f"results/{n}.txt", None) for n in range(2)], "task_id string, sub_task_id string, arrival int, status string, result string, error string")
    done.write.parquet(f"{t}/results")
    assert cli.run(spark, ["report", "--tasks", f"{t}/tasks", "--results", f"{t}/results", "--bucket", "b", "--output", f"{t}/reports"]) == 0
    (report,) = (p for p in (tmp_path / "reports").rglob("*") if p.is_file())
    assert str(report.relative_to(tmp_path / "reports")) == "reports/j/summary.html" and report.read_text().count("View Output") == 2


def test_words_are_stemmed_where_lines_are_parsed(spark):
    """One shuffle, or none, from lines to triples; the same stems and sums as Spark's."""
    rule = random.Random(8)
    parts = ["!", "+", "Y", "y", "a", "e", "i", "s", "ed", "ing", "eed", "ational", "ful", "ness", "ion", "st", "ll", "bl", "iz", "ement", "\u00c9", "ss", "ies", "\u03a3", "1", "-"]
    words = sorted({"".join(rule.choice(parts) for _ in range(rule.randrange(7))) for _ in range(5000)})
    stems = {r.word: r.stem for r in stem(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert {w: stem_word(w) for w in words} == stems
    rows, want, n = [], {}, {}
    for i in range(3000):
        x, v, y = rule.choice(words[1:40]), rule.choice(["Running", "is", "caused"]), rule.choice(words[1:40])
        prep = rule.choice(["", "Of"])
        rows.append((f"h\t{x}/NN/nsubj/2 {v}/VBD/ROOT/0 {y}/NN/{'prep_' + prep if prep else 'dobj'}/2\t{i}\t1999,1",))
        if v != "is":
            pid = " ".join(["X", stem_word(v), *([prep.lower()] if prep else []), "Y"])
            for slot, word in (("X", x), ("Y", y)):
                key = pid, slot, stem_word(word)
                want[key] = want.get(key, 0) + i
                n[key[:2]] = n.get(key[:2], 0) + 1
    got = spark.createDataFrame(rows, "value string").repartition(3).localCheckpoint()
    triples = ngrams.triples(got)
    assert triples._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {(r.pid, r.slot, r.word): r.cnt for r in triples.collect()} == want and triples.count() == len(want)
    assert "Exchange" not in ngrams.path_instances(got)._jdf.queryExecution().executedPlan().toString()
    assert {(r.pid, r.slot): r.n for r in ngrams.path_totals(got).collect()} == n


def test_alike_trees_and_tokens_leave_a_task_as_one(spark):
    got = spark.range(0, 6000, 1, 1).selectExpr("concat('h\t', if(id % 3 = 0, 'a/NN/nsubj/2 b/VBD/ROOT/0', 'a/NN/nsubj/0'), '\t', id % 7, '\t1999,1') AS value")
    (batch,) = got.toArrow().combine_chunks().to_batches()
    assert sum(len(b) for b in ngrams._shapes(ngrams._parse([batch]))) == 2
    assert sum(len(b) for b in ngrams._token_counts(ngrams._parse([batch, batch]))) == 3
    assert {tuple(r) for r in ngrams.tree_shapes(got).collect()} == {("1,-1", 2000), ("-1", 4000)}
    cnt = [sum(i % 7 for i in range(6000) if (i % 3 == 0) == pair) for pair in (True, False)]
    assert {tuple(r) for r in ngrams.token_counts(got).collect()} == {("a", "NN", "nsubj", 2, 2000, cnt[0]), ("b", "VBD", "ROOT", 0, 2000, cnt[0]), ("a", "NN", "nsubj", 0, 4000, cnt[1])}


def test_mutual_information_of_paths_moves_triples_once(spark, many_ranges):
    """The same rows as by joins with marginals, words and paths of many homes, without a join that shuffles triples."""
    rule = random.Random(4)
    words, preps = [f"w{k}" for k in range(40)] + ["dogs", "ran"], ["with", "upon", "of"]
    own = []
    for k in range(3000):
        x, v, y = (words[min(int(rule.expovariate(0.1)), 41)] for _ in range(3))
        tail = f"{y}/NN/dobj/2" if k % 3 else f"{y}/NN/prep_{rule.choice(preps)}/2"
        own.append((f"h\t{x}/NN/nsubj/2 {v}/VBD/ROOT/0 {tail}\t{rule.randrange(-1, 9)}",))
    for rows in (own, own[:1], []):
        table = spark.createDataFrame(rows, "value string").repartition(5)
        got = path_mi.mutual_information(table)
        want = mi.of_aggregate(ngrams.triples(table))
        key = lambda r: (r.pid, r.slot, r.word)
        got_rows, want_rows = (sorted(t.collect(), key=key) for t in (got, want))
        assert [(key(r), round(r.mi, 9), r.cnt) for r in got_rows] == [(key(r), round(r.mi, 9), r.cnt) for r in want_rows]
        assert len(rows) < 3000 or len(got_rows) > 500


def test_mi_ngrams_has_no_join_with_words(spark):
    plan = QUERIES["mi_ngrams"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1  # with the two sums of slots
