"""Operators for training data, against brute force, hand-labelled cases and round trips."""

import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.llm import lookalike, markup, mincut, mixing, neardup, packing, queries, reading, splitting, tokens

DATA = "/root/testdata/sf0.001"


def test_min_cut_is_the_least_labelling():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(1, 7)
        costs = [(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(n)]
        edges = [(a, b, rng.randint(1, 5)) for a in range(n) for b in range(a) if rng.random() < 0.5]
        total = lambda y: sum(c[0] if v else c[1] for c, v in zip(costs, y)) + sum(w for a, b, w in edges if y[a] != y[b])
        best = min(total([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
        assert total(mincut.label(costs, edges)) == best


CASES = [
    ("Plain prose with nothing.", []), (None, []), ("", []),
    ("The check passes when a < b and fails when b > c.", []), ("Use {name} here, rows[851] of 2^10 near ~3 ms.", []),
    ("One seat costs $40 a month and the bundle costs $75 for 3.", []), ("A grid of 3 * 4 * 319 cells; set keep_vault_rows.", []),
    ("It moved to C:\\temp\\new on the build host. x == y and R&D at 50% off.", []), ("Issue #869 was closed.\n#562 too", []),
    ("a List<probe> and <name> stay", []),
    ("text <br/> more", ["html"]), ("A &amp; B", ["html"]), ("x\n<!-- stay:a hash=sha256:00 -->", ["html"]), ('<a href="u"\n title="t">x</a>', ["html"]),
    ("# Head", ["markdown"]), ("Head\n===", ["markdown"]), ("- a\n- b", ["markdown"]), ("9. a\n10. b", ["markdown"]), ("> q", ["markdown"]),
    ("| a | b |\n|---|---|\n| 1 | 2 |", ["markdown"]), ("a `<b>x</b>` c", ["markdown"]), ("It is _not_ the __same__ ~~x~~ ***y***", ["markdown"]),
    ("see [x](y.md), ![i](j.png), [a][b].[^7]", ["markdown"]), ("literal \\*x\\*", ["markdown"]),
    ("```\n<b>x</b>\n[[l]] {{t}} \\textbf{x}\n```", ["markdown"]),
    ("== Head ==\ntext", ["wiki"]), ("'''b''' is ''i''", ["wiki"]), ("[[A|b]] [[Category:C]] {{note|a=b}} [https://x.y z]", ["wiki"]), ("{| class=\"w\"\n! a !! b\n|-\n| 1 || 2\n|}", ["wiki"]),
    ("Here \\textbf{x} and \\emph{y}; 56\\% of \\texttt{a\\_b}", ["latex"]), ("\\begin{itemize}\n  \\item a\n\\end{itemize}", ["latex"]), ("We get \\(x \\to \\infty\\) for $$\\alpha_{1}$$", ["latex"]), ("cost is $b_{i}^2 + 29b$ per", ["latex"]),
    ("# H <b>x</b>\n\nsee [[L]] and \\textbf{z}", ["html", "markdown", "wiki", "latex"]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_families(text, want):
    assert markup.families(text) == want


def test_clean_keeps_structure():
    t = "# T *x*\n\n- a `c`\n- b\n\n```py\nif a < b:\n```\n\n<h2>U</h2><p>p &lt; q</p>\n\n\\[ x^2 \\]\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n== W ==\n'''bold''' [[A|link]]\n"
    got = [tuple(p) for p in markup.clean(t)]
    assert got == [
        ("heading", 1, "T x"), ("list_item", 0, "a c"), ("list_item", 0, "b"), ("code", 0, "if a < b:"), ("heading", 2, "U"), ("paragraph", 0, "p < q"), ("formula", 0, "x^2"), ("table_row", 0, "a b"), ("table_row", 0, "1 2"),
        ("heading", 2, "W"), ("paragraph", 0, "bold link"),
    ]
    long = "word `code` *x* " * 20000
    assert markup.families(long) == ["markdown"] and len(markup.clean(long)[0].text) > 200000


def _texts(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.45:
            ws = list(rng.choice(out))
            for _ in range(rng.randint(0, max(1, len(ws) // 5))):
                k = rng.randrange(len(ws))
                what = rng.random()
                if what < 0.4:
                    ws[k] = rng.choice(vocabulary)
                elif what < 0.7:
                    ws.insert(k, rng.choice(vocabulary))
                elif len(ws) > 5:
                    del ws[k]
            if rng.random() < 0.2:
                rng.shuffle(ws)
        else:
            ws = [rng.choice(vocabulary) for _ in range(rng.choice([5, 20, 22, 40, 60, 200, 400]))]
        out.append(ws)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("region", [neardup.REGION, 12])
def test_near_duplicates_equal_brute_force(spark, region):
    texts = _texts(260, 3) + [None, "", "...", "x" * 100000]
    rows = [("t", i, t) for i, t in enumerate(texts)] + [("u", i, t) for i, t in enumerate(texts[:50])]
    df = spark.createDataFrame(rows, "item_table string, id long, text string")
    heads, members = neardup.classes(df)
    alike = {(r.item_table, r.a, r.b) for r in neardup.links(heads, region=region).collect()}
    class_of = {(r.item_table, r.id): r.class_id for r in members.join(heads.withColumnRenamed("id", "class_id"), ["item_table", "h0", "h1"]).collect()}
    got = set()
    for (k, a), x in class_of.items():
        for (m, b), y in class_of.items():
            if k == m and a < b and ((k, min(x, y), max(x, y)) in alike or x == y and len(neardup.words(texts[a])) >= 20):
                got.add((k, a, b))
    bags = [Counter(neardup.words(t)) if t else Counter() for t in texts]
    want = {(k, a, b) for k, m in (("t", len(texts)), ("u", 50)) for a in range(m) for b in range(a + 1, m) if min(sum(bags[a].values()), sum(bags[b].values())) >= 20 and neardup.similarity(bags[a], bags[b]) >= 0.7}
    assert got == want and len(want) > 50


def test_copies_form_one_class(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.range(600).select(F.lit("t").alias("item_table"), "id", F.when(F.col("id") % 2 == 0, text).otherwise(text.upper() + "!").alias("text"))
    heads, members = neardup.classes(df)
    assert sorted(r.id for r in heads.collect()) == [0, 1] and members.count() == 600
    assert [(r.a, r.b, r.similarity) for r in neardup.links(heads).collect()] == [(0, 1, 1.0)]
    none = spark.createDataFrame([], "item_table string, id long, text string")
    assert neardup.links(neardup.classes(none)[0]).count() == 0 and neardup.classes(none)[0].count() == 0


def test_split_round_trip():
    rng = random.Random(2)
    for _ in range(200):
        t = "".join(rng.choice(["word ", "a", "。", "x. ", "\n", "\n\n", "\r\n", "\t", "longword" * rng.randint(1, 9)]) for _ in range(rng.randint(1, 160)))
        size, overlap = rng.choice([(40, 8), (100, 0), (120, 30)])
        level, pieces = splitting.split(t, size, overlap)
        assert all(e - s <= size for s, e in pieces)
        covered = np.zeros(len(t), bool)
        for k, (s, e) in enumerate(pieces):
            covered[s:e] = True
            if k:
                new = s + overlap
                assert s == max(new - overlap, 0) and pieces[k - 1][1] <= new and not t[pieces[k - 1][1] : new].strip(splitting.BLANKS)
        assert all(covered[i] for i, c in enumerate(t) if c not in splitting.BLANKS)


def test_split_levels():
    size = 30
    assert splitting.split("a" * 20 + "\n\n" + "b" * 20, size, 5)[0] == "paragraph"
    assert splitting.split("```\n" + "a" * 20 + "\n\n" + "b" * 20 + "\n```", size, 5)[0] == "line"
    assert splitting.split("a" * 20 + ". " + "b" * 20 + "。" + "c" * 20, size, 5)[0] == "sentence"
    assert splitting.split("aaaa " * 20, size, 5)[0] == "word"
    assert splitting.split("a" * 90, size, 5) == ("char", [(0, 30), (25, 55), (50, 80), (75, 90)])
    with pytest.raises(ValueError):
        splitting.split("a", 5, 5)


def test_greedy_equals_a_plain_walk():
    rng = np.random.default_rng(1)
    ends = np.cumsum(rng.integers(1, 9, 500))
    starts = np.concatenate([[0], ends[:-1]])
    cuts, i = [], 0
    while i < 500:
        cuts.append(i)
        begin = starts[i] if i == 0 else max(starts[i] - 4, 0)
        i = int(np.searchsorted(ends, begin + 25, side="right"))
    assert splitting.greedy_cuts(starts, ends, 25, 4).tolist() == cuts


def test_lookalikes():
    counts = Counter()
    lookalike.bigrams(["the plain paper of a copper case", "собака раз дорога красный"], counts)
    c = lookalike.Canon(counts)
    same = [("paper", "рареr"), ("café", "cafe\u0301"), ("Ａｂ１", "Ab1"), ("a\u200bb\u00ad", "ab"), ("a\u00a0b", "a b"), ("ﬁn", "fin"), ("ёж", "е\u0308ж"), ("\ufeffx", "x")]
    other = [("x²", "x2"), ("cafe", "café"), ("Ab", "ab"), ("naive", "naïve"), ("l", "1"), ("a", "b")]
    assert all(c.key(a) == c.key(b) for a, b in same) and not any(c.key(a) == c.key(b) for a, b in other)
    assert c.text("рареr of\u2003ａ") == "paper of a" and c.text("красный") == "красный"


def test_packing():
    rng = random.Random(4)
    p, fill = packing.SumOfSquares(50), Counter()
    for k in range(4000):
        s = rng.randint(1, 50)
        fill[p.place(s, k)] += s
    assert max(fill.values()) <= 50 and sum(fill.values()) / (len(fill) * 50) > 0.97
    with pytest.raises(ValueError):
        p.place(51, 0)


def test_packing_splits_only_what_exceeds(spark):
    df = spark.createDataFrame([(1, 10), (2, 25), (3, 5), (4, 0), (5, None), (6, 20)], "id long, size long")
    rows = packing.pack(df, 10).collect()
    assert {r.id: r.n_pieces for r in rows} == {1: 1, 2: 3, 3: 1, 6: 2}
    assert max(r.filled for r in packing.fill(packing.pack(df, 10)).collect()) <= 10 and sum(r["size"] for r in rows) == 60
    assert packing.pack(df.limit(0), 10).count() == 0


def test_packing_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "CONTAINERS", 100)  # several packers and rounds
    sizes = spark.range(9000).select("id", (F.abs(F.xxhash64("id")) % 900 + 20).alias("size"))
    seen = set()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in (4, 64, 200):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        packed = packing.pack(sizes.repartition(n), 2000).collect()
        fill = Counter()
        for r in packed:
            fill[r.container_item, r.container_piece] += r["size"]
        assert len(packed) == 9000 and max(fill.values()) <= 2000 and sum(fill.values()) / (2000 * len(fill)) >= 0.98
        seen.add(frozenset(packed))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1


def test_mixing(spark):
    sized = spark.range(4000).select("id", F.when(F.col("id") < 3000, "big").when(F.col("id") < 3900, "mid").otherwise("small").alias("source"), F.lit(10).alias("tokens"))
    sized = sized.unionByName(spark.createDataFrame([(9000, None, 10)], "id long, source string, tokens int"))
    targets = spark.createDataFrame([(1, " BIG ", 1.0, 1, 0.5), (1, "mid", 1.0, 2, 0.5), (1, "small", 2.0, 3, 0.5), (1, "none", 1.0, 3, 0.5)], "mix_id int, source string, target_weight double, max_repeats int, size_ratio double")
    plan = mixing.plan(sized, targets)
    assert {r.source: r.short for r in plan.collect()} == {"big": False, "mid": False, "small": True, "none": True}
    drawn = mixing.draw(sized, plan)
    got = {r.source: r for r in mixing.shares(plan, drawn).collect()}
    assert abs(got["big"].reached_size - 4000 * 10 * 0.5 / 5) < 900 and got["small"].reached_size == 3000 and got["none"].reached_size == 0
    assert drawn.where("source = 'small' and copies != 3").count() == 0 and drawn.collect() == mixing.draw(sized, plan).collect()


def test_tokens(spark):
    if not os.path.exists(tokens.VOCABULARY):
        pytest.skip("no tokenizer files")
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "a " * 50000)], "id long, text string")
    assert [r.tokens for r in tokens.with_tokens(df, ["id"], "text").orderBy("id").collect()][:3] == [2, 0, 0]


def test_sentences():
    t = "---\na: 1\n---\n# Head\n\nOne two. Three\nfour!\n\n- item one\n- item two\n\n```\ncode here.\n```\n\n| a | b |\n\nTitle\n-----\n\nSee [the link](x) end <!-- stay:x --> `c`.\n"
    assert reading.sentences(t) == [["one", "two"], ["three", "four"], ["item", "one"], ["item", "two"], ["see", "end"]]
    assert reading.sentences("") == [] and reading.Model({}, np.zeros(5)).level("# only\n") is None


def test_prose_that_begins_like_markup_stays():
    lines = ["<https://a.b> is a site that shows text.", "<time>Tuesday</time> was a long day for all.", "= 5 is the answer.", "#7 is closed now.", "<title>Name</title> of it."]
    assert [" ".join(x) for x in reading.sentences("\n\n".join(lines))] == ["is a site that shows text", "tuesday was a long day for all", "is the answer", "is closed now", "name of it"]
    assert reading.sentences("== Head ==\n\n= One =\n\n<h2>Two</h2>\n\n<td>cell</td>\n\n</table>\n\n\\section{Three}\n") == []


def test_reading_held_out(spark):
    rng = random.Random(6)
    easy, mid, hard = ([f"{p}{i}" for i in range(60)] for p in ("e", "m", "h"))
    letters = str.maketrans("0123456789", "abcdefghij")

    def doc(grade):
        pool = easy if grade < 5 else easy + mid if grade < 12 else mid + hard
        return " ".join(" ".join(rng.choice(pool).translate(letters) for _ in range(5 + grade)) + "." for _ in range(12))

    docs = [(i, "en", doc(g), g) for i, g in enumerate([3, 8, 15] * 40)]
    labels = spark.createDataFrame([(i, "r", g) for i, _, _, g in docs] + [(500, "r", 1), (501, "r", 1), (502, None, None)], "doc_id long, rater string, grade int")
    texts = spark.createDataFrame([d[:3] for d in docs] + [(500, "de", "Ein Satz."), (501, "en", None)], "doc_id long, lang string, text string")
    model = reading.train(texts, labels)
    assert all(abs(model.level(doc(g)) - g) < 2.5 for g in [3, 8, 15] * 10)
    assert reading.train(texts, labels, limit=len(docs)).grades == model.grades  # what cannot be used takes up no room
    assert reading.train(texts, labels.limit(0)) is None and reading.train(texts.limit(0), labels) is None
    words = Counter({"a": 3, "b": 2, "c": 5, "d": 1})
    grades = {"a": 1.0, "b": 4.0, "d": 9.0}
    flat = sorted(grades[w] for w, n in words.items() if w in grades for _ in range(n))
    assert reading.features(words, grades) == [1.0, *(flat[min(int(q * len(flat)), len(flat) - 1)] for q in reading.QUANTILES)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))


def test_every_document_has_a_level_or_a_reason(spark, tmp_path):
    docs = [(1, "en", "One plain sentence here."), (2, "de", "Ein Satz steht hier."), (3, None, "No language."), (4, "en-US", "# only\n"), (5, "EN", None), (6, "en", "Another plain sentence.")]
    spark.createDataFrame(docs, "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a", 3), (6, "a", 5)], "doc_id long, rater string, grade int").write.parquet(str(tmp_path / "reading_labels.parquet"))
    got = {r.doc_id: r for r in queries.p9_levels(spark, str(tmp_path)).collect()}
    assert {i: r.status for i, r in got.items()} == {1: "levelled", 2: "not calibrated", 3: "not calibrated", 4: "no prose", 5: "no prose", 6: "levelled"}
    assert all((r.level is not None) == (r.status == "levelled") for r in got.values())
    assert sum(r.n_documents for r in queries.p9_profile(spark, str(tmp_path)).collect()) == len(docs)


def test_text_of_footnotes_stays():
    t = "Text[^1] goes on.[^long]\n\n[^1]: The text of the *note*.\n[^long]: A second note\nof two lines.\n  [^3]: Indented.\n[ref]: http://example.org/x\n"
    assert [p.text for p in markup.clean(t)] == ["Text goes on.", "The text of the note.", "A second note of two lines.", "Indented."]
    assert markup.families(t) == ["markdown"]


def test_clean_survives_any_code_point():
    for t in ("\ue001x", "\ue003 heading", "\ue0031", "\ue001\ue002", "a\ue000b *c*", "# \ue004\n\n- \ue005"):
        assert markup.clean(t)
    rng = random.Random(8)
    signs = [chr(c) for c in (0xE000, 0xE001, 0xE002, 0xE003, 0xE004, 0xE005, 0xE006, 0x0, 0xFFFF, 0x10FFFF, 0x2028, 0x85)] + list("#*`<>|\\[]{}$=\n- 1.a")
    for _ in range(3000):
        t = "".join(rng.choice(signs) for _ in range(rng.randint(1, 40)))
        markup.families(t), markup.clean(t)


def test_what_is_content_is_not_taken_out():
    assert markup.families("\\[one two three four five *bold* words\\]") == ["markdown"]
    assert [tuple(p) for p in markup.clean("\\[one two three four five *bold* words\\]")] == [("paragraph", 0, "[one two three four five bold words]")]
    assert markup.families("see \\(this\n\nand *that* there are many words\\)") == ["markdown"]
    assert [p.kind for p in markup.clean("so \\[ x^2 \\] it is")] == ["paragraph", "formula", "paragraph"]


def test_labels_change_through_edges():
    def families(t, labels):
        return {s.family for s, yes in zip(t.spans, labels) if yes}

    g = markup.propose("It moved to C:\\to\\log on the host.")
    assert families(g, mincut.alone(g.costs())) == {"latex"} and not families(g, g.labels())
    g = markup.propose("put <item-name> there")
    assert families(g, mincut.alone(g.costs())) == {"html"} and not families(g, g.labels())
    g = markup.propose("<item-name>put it</item-name>")
    assert families(g, g.labels()) == {"html"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_labels_change_through_edges_on_the_tables(spark):
    changed, wrong_alone = 0, 0
    texts = [r.text for r in queries._texts(spark, DATA.replace("0.001", "0.01")).where("text is not null").select("text").distinct().collect()]
    for t in texts:
        g = markup.propose(markup._one_line_end(t))
        with_edges, alone = g.labels(), mincut.alone(g.costs())
        changed += sum(a != b for a, b in zip(with_edges, alone))
        wrong_alone += {s.family for s, y in zip(g.spans, with_edges) if y} != {s.family for s, y in zip(g.spans, alone) if y}
    assert changed > 0 and wrong_alone > 0
