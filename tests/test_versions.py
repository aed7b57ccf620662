"""Parsing, lint, comparison, resolution, edits."""

import re

import pytest
from pyspark.sql import functions as F

from blockloom.functions import text as X
from blockloom.functions.headings import canonical_heading, paths_by_line
from blockloom.functions.similarity import Candidates, body_score, match_form, ratio
from blockloom.operators import bridge, cache, children, commit, diff, lint, perturb, render, resolve, score, segment, stamp

K = ["d"]


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "d int, text string, content string")


def blocks(spark, *texts):
    return segment.blocks(docs(spark, *texts).select("d", "text"), K)


def codes(df):
    return sorted((r.code, r.id) for r in df.collect())


def test_body_rule(spark):
    t = " \n\ta \t\r\nb\x0b\n\n c\r\n\n"
    got = spark.createDataFrame([(t,), ("",), (None,)], "t string").select(X.normalize_body(F.col("t"))).collect()
    assert [r[0] for r in got] == ["\ta\nb\n\n c", "", None]


def test_parse_orphans_and_folding(spark):
    t = "<!-- stay:o -->\n\nA\n\n<!-- stay:a hash=sha256:ABCD -->\n{/* stay:b */}\n\nB <!-- stay:k=v stay:ok -->\n"
    rows = blocks(spark, t).orderBy("pos").collect()
    assert [(r.idx, r.line, r.content, [m.id for m in r.markers]) for r in rows] == [(-1, 1, "", ["o"]), (0, 3, "A", ["a", "b"]), (1, 8, "B", [None])]
    assert rows[1].markers[0].hash == "abcd" and [m.line for m in rows[1].markers] == [5, 6] and rows[2].markers[0].malformed


def test_front_matter(spark):
    good, thematic, comment = "---\na: 1\n---\n\nX\n", "---\n\nIntro\n\n---\n", "---\n# x\n---\n"
    got = {r.d: (r.line, r.content) for r in blocks(spark, good).collect()}
    assert got == {0: (5, "X")}
    assert blocks(spark, thematic).count() == 3 and blocks(spark, comment).count() == 1


def test_null_and_empty_documents(spark):
    rows = blocks(spark, None, "", "\n \n")
    assert rows.count() == 0
    assert lint.marker_findings(segment.markers(rows, K), K).count() == 0


def test_long_document_against_model(spark):
    t = "\n".join(f"line {i}" if i % 7 else "" for i in range(5000))
    want = [x for x in re.split(r"\n\n+", t) if x]
    assert [r.content for r in blocks(spark, t).orderBy("pos").collect()] == [x.strip("\n") for x in want]


def test_lint(spark):
    t = "A\n<!-- stay:x hash=sha256:0000 -->\n\nB\n<!-- stay:x -->\n<!-- stay:a=b -->\n"
    found = lint.marker_findings(segment.markers(blocks(spark, t, "C\n"), K), K)
    assert codes(found) == [("DUPLICATE_ID", "x"), ("HASH_DRIFT", "x"), ("MALFORMED_MARKER", None)]
    report = {r.d: r.report for r in lint.text_report(docs(spark, t, "C\n").select("d", F.concat(F.lit("f"), "d").alias("n")), found, K, "n").collect()}
    assert report[1] == "f1: clean (no findings)" and "1 hash-drift finding hidden" in report[0] and report[0].endswith("2 error, 1 warn, 0 info")


def compared(spark, before, after):
    a, b = (diff.id_index(blocks(spark, t), K) for t in (before, after))
    return diff.compare(a, b, K)


def test_diff(spark):
    b = "A\n<!-- stay:a -->\n\nB\n<!-- stay:b -->\n\nC\n<!-- stay:c -->\n\n- x\n- y\n<!-- stay:l -->\n"
    a = "B\n<!-- stay:a -->\n\nA2\n<!-- stay:b -->\n\n- x\n<!-- stay:l -->\n\nN\n<!-- stay:n -->\n\nN2\n<!-- stay:n -->\n"
    found = diff.findings(compared(spark, b, a), K, check_collections=True)
    assert codes(found) == [("COLLECTION_SHRANK", "l"), ("DROPPED_ID", "c"), ("DUPLICATED_ID", "n"), ("HASH_DRIFT", "b"), ("HASH_DRIFT", "l"), ("NEW_ID", "n"), ("RELOCATED_ID", "a")]
    assert diff.findings(compared(spark, b, b), K, True).count() == 0


def test_duplicated_baseline_id_is_new(spark):
    b = "A\n<!-- stay:a -->\n\nB\n<!-- stay:a -->\n"
    assert codes(diff.findings(compared(spark, b, "A\n<!-- stay:a -->\n"), K)) == [("NEW_ID", "a")]


def test_stamp_round_trip(spark):
    t = "A\n\nB\n<!-- stay:b hash=sha256:0000 -->\n"
    once = stamp.stamp(blocks(spark, t), K)
    again = stamp.stamp(segment.blocks(once, K), K)
    assert once.collect() == again.collect()
    fresh = segment.blocks(stamp.restamp(segment.blocks(once, K), K), K)
    assert lint.marker_findings(segment.markers(fresh, K), K).count() == 0


def test_ratio_is_order_sensitive_and_best_is_exact():
    assert (ratio("tide", "diet"), ratio("diet", "tide")) == (0.25, 0.5)
    texts = ["the cat sat on the mat", "the cat sat on a mat today", "zzz", "the cat sat on the mat!"]
    for q in ("the cat sat on the mat", "cat sat", "nothing alike", ""):
        plain = sorted(((body_score(match_form(q), match_form(t)), i) for i, t in enumerate(texts)), reverse=True)
        i, s, r = Candidates(texts).best(q, "", "")
        assert (i, s, r) == (plain[0][1], plain[0][0], plain[1][0])
    assert Candidates([]).best("x", "", "") == (-1, 0.0, 0.0)


def test_ladder(spark):
    b = "# T\n<!-- stay:t -->\n\nThe quick brown fox jumps over the lazy dog today.\n<!-- stay:q -->\n\nTwin\n<!-- stay:w -->\n\nGone for ever and ever\n<!-- stay:g -->\n"
    a = "# T\n\nThe quick brown fox jumped over the lazy dog today.\n\nTwin\n\nTwin\n"
    got = {r.id: (r.method, r.target) for r in resolve.resolve(resolve.anchors(blocks(spark, b), K), blocks(spark, a), K).collect()}
    assert got == {"t": ("hash", 0), "q": ("quote", 1), "w": ("detached", None), "g": ("detached", None)}
    with pytest.raises(ValueError):
        resolve.resolve(resolve.anchors(blocks(spark, b), K), blocks(spark, a), K, heading_mode="x")


def test_edits_and_scores(spark):
    t = "# H\n\nOne sentence here. Two the end.\n\nAnother order, with data.\n\n## S\n\nLast one.\n\n## U\n\nTail.\n"
    base = perturb.annotate(blocks(spark, t), K)
    texts = lambda op: [b.text for b in perturb.apply(base, K, op).first().pb]
    assert texts("split")[1:3] == ["One sentence here.", "Two the end."]
    assert texts("merge")[1] == "One sentence here. Two the end. Another order, with data."
    assert "Another order, with data." not in texts("delete") and len(texts("insert")) == 9
    assert texts("heavy_paraphrase")[2] == "Another request and with information. (revised)"
    assert texts("reorder")[0] == "Tail." and texts("clone")[1] == texts("clone")[2]
    assert texts("section_move")[-2:] == ["## S", "Last one."] and "## S" not in texts("heading_delete")
    assert texts("cross_section_move")[-2:] == ["Last one.", "Tail."] and texts("heading_rename")[3] == "## S (revised)"
    truth = {r.id: r.accept for r in perturb.truth_rows(perturb.apply(base, K, "delete"), K).collect()}
    assert sorted(map(str, truth.values())) == sorted(["None", "[0]", "[1]", "[2]", "[3]", "[4]", "[5]"])


def test_rates(spark):
    rows = spark.createDataFrame([("a", "correct")] * 3 + [("a", "wrong"), ("b", "missed"), ("b", "correct_detach")], "op string, cat string")
    got = {r.op: (round(r.recovery, 3), round(r.false_rate, 3)) for r in score.rates(score.tally(rows, ["op"], total=True)).collect()}
    assert got == {"a": (0.75, 0.25), "b": (0.0, 0.0), None: (0.6, 0.167)}
    low, high = score.clopper_pearson(9, 10)
    assert abs(low - 0.55498) < 1e-4 and abs(high - 0.99747) < 1e-4 and score.clopper_pearson(0, 0) == (0.0, 1.0)


def test_cache(spark):
    old = spark.createDataFrame([(0, "a", "1"), (0, "b", "2"), (0, "c", "3")], "d int, id string, body_hash string")
    new = spark.createDataFrame([(0, "a", "1"), (0, "b", "9"), (0, "n", "4")], "d int, id string, body_hash string")
    assert sorted((r.id, r.action) for r in cache.decide(old, new, K).collect()) == [("a", "reuse"), ("b", "reembed"), ("c", "evict"), ("n", "reembed")]
    assert {r.action for r in cache.decide(old, old, K).collect()} == {"reuse"}


def test_commit(spark):
    e = spark.createDataFrame(
        [
            (1, 0, "M", "a.md", "a.md", "A\n<!-- stay:a -->\n\nB\n<!-- stay:b -->\n", "A\n<!-- stay:a -->\n"),
            (1, 1, "M", "b.md", "b.md", "X\n", "X\n\nB\n<!-- stay:b -->\n"),
            (1, 2, "D", "old.md", "old.md", "P\n<!-- stay:p -->\n\nQ\n<!-- stay:q -->\n", None),
            (1, 3, "A", "new.md", "new.md", None, "P\n<!-- stay:p -->\n"),
            (1, 4, "D", "gone.md", "gone.md", "Z\n<!-- stay:z -->\n", None),
        ],
        "commit_id int, seq int, status string, src string, dst string, before string, after string",
    )
    assert {r.dst: r.origin for r in commit.pairings(e).collect()} == {"a.md": "a.md", "b.md": "b.md", "new.md": "old.md"}
    f = commit.findings(e)
    assert [r.note for r in commit.move_notes(f).collect()] == ["b: moved out of a.md into b.md (still in this commit, not blocking)"]
    assert [(r.label, r.code, r.id) for r in commit.reports(f).where("level = 'error'").collect()] == [("new.md (baseline old.md)", "DROPPED_ID", "q")]
    assert [r.note for r in commit.deletion_notes(e).collect()] == ["gone.md: deleted with 1 stay(s) that no staged file carries (z)"]


def test_headings():
    lines = "# A\n\ntext\n\n```\n# no\n```\n\nB b\n---\n\n<div>\n# no\n</div>\n\n### C\nx".split("\n")
    paths = paths_by_line(lines)
    assert paths[0] == [] and paths[2] == ["A"] and paths[5] == ["A"] and paths[8] == ["A"] and paths[12] == ["A", "B b"] and paths[16] == ["A", "B b", "C"]
    assert canonical_heading("**Roll** `back` [x](y) a_b_c") == "roll back x a_b_c"


def test_children(spark):
    b = "- one <!-- stay:i1 subhash=sha256:0 -->\n- two <!-- stay:i2 subhash=sha256:0 -->\n- three <!-- stay:i3 subhash=sha256:0 -->\n<!-- stay:p -->\n"
    a = "- two\n- three\n<!-- stay:p -->\n"
    before, after = docs(spark, b), docs(spark, a)
    got = {r.id: (r.method, r.target) for r in children.child_resolutions(before, after, K).collect()}
    assert got == {"i1": ("detached", None), "i2": ("hash", 0), "i3": ("hash", 1)}
    assert ("CHILD_DROPPED", "i1") in codes(children.child_diff(before, after, K))
    assert children.flat_items("- a\n    - b", 1) == [] and len(children.tree_items("- a\n  - b\n- c", 1)) == 2


def test_top_level():
    from blockloom.functions.markdown import top_level

    t = "para\nmore\n\n- a\n\n  b\n- c\n\n```\nx\n\ny\n```\n> q\nlazy\n\n[r]: u\n\n<div>\nz\n\nTitle\n===\n    code\n".split("\n")
    assert [(a, b, k) for a, b, k in top_level(t)] == [(0, 2, "paragraph"), (3, 7, "list"), (8, 13, "fence"), (13, 15, "quote"), (18, 20, "html"), (21, 23, "heading"), (23, 24, "code")]


def test_bridge(spark):
    w = '<block id="a">\n  # T\n</block>\n\n<block id="b">\n  x\n  y\n</block>\n'
    plain = bridge.unwrap(w)
    back = bridge.to_wrapped(docs(spark, plain).select("d", "text"), blocks(spark, plain), K).first()
    assert back.error is None and back.text == w
    for bad in ("x", '<block id="a" x="1">\n  a\n</block>', '<block id="a">\n  - a\n</block>', '<block id="a">\n  a\n', '<block id="a">\n  a\n\n  b\n</block>', '<block id="a">\nb\n</block>'):
        with pytest.raises(bridge.Rejected):
            bridge.unwrap(bad)
    fenced = "```\n<!-- stay:x -->\n```\n<!-- stay:y -->\n"
    assert bridge.to_wrapped(docs(spark, fenced).select("d", "text"), blocks(spark, fenced), K).first().error


def test_render(spark):
    i = "A\n<!-- stay:a -->\n"
    runs = [("keep", i, i, 0), ("drop", i, "A\n", 0), ("esc", i, "A\n&lt;!-- stay:a --&gt;\n", 0), ("span", i, "A\n`<!-- stay:a -->`{=html}\n", 0), ("err", i, "", 2)]
    df = spark.createDataFrame([(n, x, o, rc, "boom\nx") for n, x, o, rc in runs], "run_id string, input string, out string, rc int, err string")
    assert {r.run_id: r.verdict for r in render.roundtrip(df).collect()} == {"keep": "SURVIVES", "drop": "DROPPED", "esc": "MANGLED", "span": "MANGLED", "err": "ERROR"}
    assert {r.run_id: r.verdict for r in render.rendered(df).collect()}["esc"] == "LEAKED_VISIBLE"


def test_ratios_are_those_of_the_library_and_bounds_hold():
    import random
    from difflib import SequenceMatcher

    from blockloom.functions.similarity import Texts, matched, reaches

    draw = random.Random(3)
    words = "the report of a late packet is sent once per hour before every stale cache was warmed again é".split()
    for _ in range(300):
        a, b = (" ".join(draw.choices(words, k=draw.randint(1, 20))) if draw.random() < 0.7 else "".join(draw.choices("ab ", k=draw.randint(1, 9))) for _ in "ab")
        want = SequenceMatcher(None, a, b, autojunk=False).ratio()
        assert ratio(a, b) == want and reaches(a, b, body_score(a, b)) and not reaches(a, b, body_score(a, b) + 1e-6)
        low, high = matched(a, b, least=0.9 * (len(a) + len(b)) / 2)
        assert 2 * low / (len(a) + len(b)) <= want <= 2 * high / (len(a) + len(b))
        for near in (Texts([b]), Texts([b, "", *words, a])):
            assert near.by_letters(a)[0] >= want and near.by_order(a)[0] >= want


def test_a_long_document_is_scored_in_little_time():
    import time

    texts = [f"If {i * 7919 % 997} {'packets records drafts leases'.split()[i % 4]} are {'flushed merged counted'.split()[i % 3]} at once, then writer {i * 31} limits catalog {i * i} and summarizes the rest of report {i % 13}." for i in range(300)]
    began, near = time.process_time(), Candidates([t + " (revised)" for t in texts])
    assert [near.best(t, "", "", threshold=0.5, margin=0.05)[0] for t in texts] == list(range(300))
    assert perturb._least_rivalled(texts, list(range(300))) is not None
    assert time.process_time() - began < 20  # minutes with a score for every pair
