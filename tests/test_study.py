"""Edits, resolver and scores together."""

from blockloom.api import DocFrame
from blockloom.operators import perturb, score, study

K = ["doc"]
TEXT = """# Guide

The archive keeps every snapshot for thirty days, and older ones are removed.

Backups run at night in the smaller region and never take a lock on anything.

## Setup

Install the client first. Then run the order check, with a clean folder.

Nothing here depends on the network or on the clock of the machine.

## Tail

Done.
"""


def test_study_is_safe_and_arms_compare(spark):
    df = spark.createDataFrame([("a", TEXT)], "doc string, text string")
    ops = ["reorder", "delete", "clone", "edit_in_place", "heading_rename", "cross_section_move_edit"]
    s = study.Study(df, K, ops, paths=True)
    kept = study.Study(df, K, ops, strip=False)
    got = {r.op: r for r in score.rates(score.tally(s.scored(), ["op"])).collect()}
    assert got["reorder"].recovery == 1.0 and got["delete"].correct_detach == 1 and got["clone"].missed == 1 and got["clone"].false_rate == 0.0
    assert score.tally(kept.scored(), ["op"]).where("wrong + missed + false_attach > 0").count() == 0
    arms = {r.arm: r for r in study.arm_report(study.arms(s, ["A", "D12c", "C"]), K).collect()}
    assert arms["A"].lost == 0 and arms["A"].unsafe == 0 and arms["D12c"].n == arms["A"].n
    assert len(perturb.SECTION_OPERATORS) == 5


def test_facade(spark):
    df = spark.createDataFrame([("a", TEXT), ("b", None)], "doc string, text string")
    one = DocFrame(df, K).stamp()
    assert one.lint().count() == 0 and one.diff(one).count() == 0
    assert {r.method for r in one.resolve(one).collect()} == {"marker"}
    assert one.chunks(strict=True).count() == one.blocks.count() == 8
    one.register("v_")
    assert spark.sql("select count(*) from v_markers").first()[0] == 8


def test_study_queries_cover_every_edit(spark, tmp_path):
    from blockloom.plans import identity

    spark.createDataFrame([(1, TEXT)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    ops, both = set(perturb.OPERATORS | perturb.SECTION_OPERATORS), {"stripped", "kept"}
    cells = identity.eval_rollup(spark, str(tmp_path)).collect()
    assert {(r.markers, r.op) for r in cells if r.op} == {(m, o) for m in both for o in ops}
    total = next(r for r in cells if r.markers is None)
    assert total.n == sum(r.n for r in cells if r.op)
    by_margin = identity.margin_ablation(spark, str(tmp_path)).collect()
    assert {(r.markers, r.op, r.margin) for r in by_margin} == {(m, o, x) for m in both for o in ops for x in (0.0, 0.05)}
    by_arm = identity.heading_arms(spark, str(tmp_path)).collect()
    assert {(r.markers, r.op, r.arm) for r in by_arm} == {(m, o, a[0]) for m in both for o in ops for a in study.ARMS}


def test_settings_in_one_pass_give_what_each_gives_alone(spark):
    s = study.Study(spark.createDataFrame([("a", TEXT)], "doc string, text string"), K, ["heavy_paraphrase", "decoy", "cross_section_move_edit"], paths=True)
    got = study.arms(s)
    for name, clamp, mode, weight, gate in study.ARMS:
        cols = ["op", "doc", "id", "cat", "method", "score", "target"]
        alone = s.scored(heading_mode=mode, weight=weight, clamp=clamp, gate=gate)
        assert sorted(map(str, got.where(got.arm == name).select(cols).collect())) == sorted(map(str, alone.select(cols).collect()))


def test_every_edit_and_its_truth_has_a_query(spark, tmp_path):
    from blockloom.plans import identity

    assert all({f"perturb_{op}", f"truth_{op}"} <= set(identity.QUERIES) for op in perturb.OPERATORS | perturb.SECTION_OPERATORS)
    spark.createDataFrame([(1, TEXT)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert identity.QUERIES["perturb_cross_section_move_edit"](spark, str(tmp_path)).count() == 8
    truth = identity.QUERIES["truth_heading_delete"](spark, str(tmp_path)).collect()
    assert len(truth) == 8 and sum(r.accept is None for r in truth) == 1


def test_rewrites_are_scored_by_their_markers(spark):
    from blockloom.operators import rewrites

    before = "# Guide\n<!-- stay:h -->\n\nThe archive keeps old files for a year.\n<!-- stay:a -->\n\nBackups run every night at two.\n<!-- stay:b -->\n\nNothing else here.\n<!-- stay:c -->\n"
    after = "# Guide\n<!-- stay:h -->\n\nBackups run every single night at two.\n<!-- stay:b -->\n\nThe archive keeps old files for a year.\n<!-- stay:a -->\n"
    df = lambda t: spark.createDataFrame([("d", t), ("n", None)], "doc string, text string")
    from blockloom.session import stored

    scored = stored(rewrites.score_blocks(df(before), df(after), K), "scored")
    rows = {r.id: r for r in scored.collect()}
    assert {i: r.cat for i, r in rows.items()} == {"h": "correct", "a": "correct", "b": "correct", "c": "no_truth"}
    assert rows["b"].method == "quote" and 0.8 < rows["b"].sim < 1 and rows["a"].sim == 1.0 and rows["c"].gold is None
    s = rewrites.summary(scored).first()
    assert (s.n, s.correct, s.wrong, s.exact, s.quote_saves) == (3, 3, 0, 2, 1)
    assert {(r.value, r.n) for r in rewrites.report(scored, ["method"]).where("slice = 'band'").collect()} == {("0.9-1.0", 2), ("0.7-0.9", 1)}
    assert rewrites.summary(scored.limit(0)).first().n == 0


def test_shape_and_matrix(spark):
    from blockloom.operators import render

    text = "# A\n\nThe archive keeps old files for a year.\n\n# B\n\nThe archive keeps old files for a week.\n\nSomething else altogether, quite so.\n"
    r = study.shape(spark.createDataFrame([("d", text)], "doc string, text string"), K, 14).first()
    assert (r.blocks, r.cross_section, r.same_section, r.cross_section_cases) == (5, 2, 2, 28) and r.uncontested == 1  # the two headings are like each other
    v = [("mdx", "render", "mdx", "INVISIBLE", "fine"), ("mdx", "render", "blocks", "ERROR", "bad"), ("github", "render", "blocks", "INVISIBLE", "fine"), ("github", "render", "hash", "LEAKED_VISIBLE", "seen")]
    cells = {r.tool: r for r in render.matrix(spark.createDataFrame(v, "tool string, axis string, fixture string, verdict string, note string"), render.tools(spark)).collect()}
    assert cells["mdx"].verdict == "INVISIBLE" and cells["mdx"].note.startswith("fine; ") and cells["mdx"].divergent and cells["github"].verdict == "LEAKED_VISIBLE" and len(render.TOOLS) == 14


def test_shape_is_that_of_all_pairs_and_a_long_document_takes_little_time(spark):
    import random
    import time

    from blockloom.functions.similarity import body_score, match_form

    draw = random.Random(4)
    words = "the report of a late packet is sent once per hour before every stale cache was warmed again".split()
    sections = [[" ".join(draw.choices(words, k=draw.randint(1, 14))) for _ in range(draw.randint(1, 9))] for _ in range(4)]
    text = "\n\n".join(x for k, s in enumerate(sections) for x in [f"# {'ABCD'[k] * 30}", *s]) + "\n"
    blocks = [(x, "") if j < 0 else (x, k) for k, s in enumerate(sections) for j, x in enumerate([f"# {'ABCD'[k] * 30}", *s], -1)]
    rivals = [{"same" if p == q else "cross" for j, (y, q) in enumerate(blocks) if j != i and body_score(match_form(x), match_form(y)) >= 0.5} for i, (x, p) in enumerate(blocks)]
    long = "\n\n".join(f"Then writer {i * 31} limits catalog {i * i}, and the {words[i % 17]} {words[i * 7 % 17]} of report {i * 7919 % 997} summarizes the rest at {i % 13}." for i in range(400)) + "\n"
    began = time.time()
    got = {r.doc: r for r in study.shape(spark.createDataFrame([("a", text), ("long", long), ("n", None)], "doc string, text string"), K, 14).collect()}
    assert time.time() - began < 15  # 80,000 pairs
    assert (got["a"].cross_section, got["a"].same_section) == (sum("cross" in r for r in rivals), sum(r == {"same"} for r in rivals)) and got["long"].blocks == got["long"].same_section == 400


def test_markers_stripped_and_kept_share_one_study(spark):
    df = spark.createDataFrame([("a", TEXT)], "doc string, text string")
    ops = ["reorder", "heavy_paraphrase"]
    one = study.Study(df, K, ops)
    other, alone = one.with_markers(False), study.Study(df, K, ops, strip=False)
    assert other.applied is one.applied and other.anchors is one.anchors and other.truth is one.truth
    assert sorted(map(str, other.scored().collect())) == sorted(map(str, alone.scored().collect()))
