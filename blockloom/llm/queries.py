"""Queries of the operators in this package, over whole tables and whole texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored, table
from . import lookalike, markup, mixing, neardup, packing, reading, splitting, tokens


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks and chunks as (item_table, item_id, text). A row that was delivered twice is still there twice."""
    blocks = table(spark, sf_dir, "blocks").select(F.lit("blocks").alias("item_table"), F.col("block_id").alias("item_id"), F.col("content").alias("text"))
    chunks = table(spark, sf_dir, "chunks").select(F.lit("chunks").alias("item_table"), F.col("row_id").alias("item_id"), "text")
    return blocks.unionByName(chunks)


def _once(df: DataFrame) -> DataFrame:
    """One row per item."""
    return df.dropDuplicates(["item_table", "item_id"])


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kinds, ids, fam = b.column(0).to_pylist(), b.column(1).to_pylist(), []
        for k, i, t in zip(kinds, ids, b.column(2).to_pylist()):
            fam += [(k, i, f) for f in markup.families(t)]
        k, i, f = zip(*fam) if fam else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(i, pa.int64()), pa.array(f, pa.string())], names=["item_table", "item_id", "family"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of markup in each item. Only texts with a sign that markup needs go to the Python stage."""
    signed = _texts(spark, sf_dir).where(F.col("text").rlike(markup.SIGNS))
    return signed.mapInArrow(_families, "item_table string, item_id long, family string").distinct()


PIECES = "item_table string, item_id long, piece_no int, kind string, level int, text string"


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(k, i, n, *p) for k, i, t in zip(*(c.to_pylist() for c in b.columns)) for n, p in enumerate(markup.clean(t))]
        cols = list(zip(*rows)) if rows else [()] * 6
        types = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in PIECES.split(", ")])


def p2_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean text of every item in pieces: headings, list entries, code, formulas, table rows, quotes and paragraphs."""
    return _once(_texts(spark, sf_dir)).mapInArrow(_clean, PIECES)


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "blocks").select(F.lit("blocks").alias("item_table"), F.col("block_id").alias("id"), F.col("content").alias("text"))
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("prefix", "quote", "suffix")]
    selectors = table(spark, sf_dir, "selectors").select(F.lit("selectors").alias("item_table"), F.col("selector_id").alias("id"), F.concat_ws(" ", *parts).alias("text"))
    return blocks.unionByName(selectors)


def _joined(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Links between classes, and members with their class and its number of words."""
    heads, members = neardup.classes(_passages(spark, sf_dir))
    heads = stored(heads, "heads")
    named = heads.select("item_table", "h0", "h1", F.col("id").alias("class_id"), "n_words")
    return neardup.links(heads), members.join(named, ["item_table", "h0", "h1"]).select("item_table", "id", "class_id", "n_words")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows whose bags of words are alike to 0.7 or more: pairs between classes, put out for all members."""
    links, members = _joined(spark, sf_dir)
    of = stored(members.where("n_words >= 20"), "members")
    a = of.select("item_table", F.col("class_id").alias("a"), F.col("id").alias("i"))
    b = of.select("item_table", F.col("class_id").alias("b"), F.col("id").alias("j"))
    across = links.select("item_table", "a", "b").join(a, ["item_table", "a"]).join(b, ["item_table", "b"]).select("item_table", F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"))
    copies = of.groupBy("item_table", "class_id").agg(F.count("*").alias("n")).where("n > 1").select("item_table", F.col("class_id").alias("a"))
    same = a.join(copies, ["item_table", "a"], "left_semi")
    inside = same.alias("x").join(same.withColumnRenamed("i", "j").alias("y"), ["item_table", "a"]).where("i < j").select("item_table", F.col("i").alias("id_a"), F.col("j").alias("id_b"))
    return across.unionByName(inside)


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per passage with its class of copies and the number of rows it is linked to."""
    links, members = _joined(spark, sf_dir)
    of = stored(members, "members")
    size = of.groupBy("item_table", "class_id").agg(F.count("*").alias("n"), F.max("n_words").alias("w"))
    links = stored(links.select("item_table", "a", "b"), "links")
    both = links.unionByName(links.select("item_table", F.col("b").alias("a"), F.col("a").alias("b")))
    other = both.join(size.select("item_table", F.col("class_id").alias("b"), "n"), ["item_table", "b"]).groupBy("item_table", F.col("a").alias("class_id")).agg(F.sum("n").alias("others"))
    per = size.join(other, ["item_table", "class_id"], "left").select("item_table", "class_id", (F.coalesce("others", F.lit(0)) + F.when(F.col("w") >= 20, F.col("n") - 1).otherwise(0)).alias("n_links"))
    return of.join(per, ["item_table", "class_id"]).select("item_table", F.col("id").alias("item_id"), "class_id", "n_links")


def _oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = table(spark, sf_dir, "size_limits").where("unit = 'chars'").select("item_table", "max_size", "overlap").distinct()
    return _texts(spark, sf_dir).join(limits, "item_table").where(F.length("text") > F.col("max_size"))


CUT = "item_table string, item_id long, boundary string, piece_no int, start int, end int, text string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in CUT.split(", ")]
    for b in batches:
        rows = []
        for k, i, t, size, overlap in zip(*(c.to_pylist() for c in b.columns)):
            level, pieces = splitting.split(t, size, overlap)
            rows += [(k, i, level, n, s, e, t[s:e]) for n, (s, e) in enumerate(pieces)] or [(k, i, level, 0, 0, 0, "")]
        cols = list(zip(*rows)) if rows else [()] * 7
        types = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every item over the limit of its table."""
    return _once(_oversized(spark, sf_dir)).select("item_table", "item_id", "text", "max_size", "overlap").mapInArrow(_cut, CUT)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items over the limit and the boundaries at which they were cut."""
    return p4_pieces(spark, sf_dir).select("item_table", "item_id", "boundary").distinct()


def _stored_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashes = table(spark, sf_dir, "markers").select(F.lit("markers").alias("item_table"), F.col("marker_id").alias("item_id"), F.col("hash").alias("text"))
    return _texts(spark, sf_dir).unionByName(hashes).where("text is not null")


def _bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for b in batches:
        lookalike.bigrams(b.column(0).to_pylist(), counts)
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["pair", "n"])


def bigram_model(texts: DataFrame) -> dict[str, int]:
    """Bigrams of letters over all texts. Their number is bound by the three alphabets, not by the data."""
    rows = texts.select("text").mapInArrow(_bigrams, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return {r["pair"]: r["n"] for r in rows.toLocalIterator()}


def _canonical(model, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        canon = lookalike.Canon(model.value)
        for b in batches:
            forms = [canon.text(t) for t in b.column(2).to_pylist()]
            if with_text:
                out, kind = [pa.array(forms, pa.string())], ["form"]
            else:
                keys = [xxhash.xxh3_128_digest(f.replace(" ", "")) for f in forms]
                out = [pa.array(keys, pa.binary()), pa.array([xxhash.xxh3_128_digest(lookalike.stored(t)) for t in b.column(2).to_pylist()], pa.binary())]
                kind = ["looks", "stored"]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *out], names=["item_table", "item_id", *kind])

    return run


def p6_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every text."""
    texts = _stored_forms(spark, sf_dir)
    model = spark.sparkContext.broadcast(bigram_model(texts))
    return _once(texts).mapInArrow(_canonical(model, True), "item_table string, item_id long, form string")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows that look the same and are stored differently.

    Forms are compared by hash. Looks with one stored form only drop out by a pre-aggregation, so that a text that a
    third of all rows hold gathers nowhere.
    """
    texts = _stored_forms(spark, sf_dir)
    model = spark.sparkContext.broadcast(bigram_model(texts))
    forms = stored(texts.mapInArrow(_canonical(model, False), "item_table string, item_id long, looks binary, stored binary"), "forms")
    several = forms.groupBy("item_table", "looks").agg(F.min("stored").alias("x"), F.max("stored").alias("y")).where("x != y").select("item_table", "looks")
    rows = forms.join(several, ["item_table", "looks"], "left_semi").distinct()
    a, b = rows.withColumnsRenamed({"item_id": "id_a", "stored": "s_a"}), rows.withColumnsRenamed({"item_id": "id_b", "stored": "s_b"})
    return a.join(b, ["item_table", "looks"]).where("id_a < id_b and s_a != s_b").select("item_table", "id_a", "id_b").distinct()


def _capacity(spark: SparkSession, sf_dir: str) -> int:
    return int(table(spark, sf_dir, "size_limits").where("item_table = 'documents' and unit = 'tokens'").agg(F.min("max_size")).first()[0])


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = tokens.with_tokens(table(spark, sf_dir, "documents"), ["doc_id"], "text").select(F.col("doc_id").alias("id"), F.col("tokens").alias("size"))
    return packing.pack(sizes, _capacity(spark, sf_dir))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, or piece of one that exceeds the capacity, with its container."""
    return _packed(spark, sf_dir).withColumnRenamed("id", "doc_id")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, their least possible number and the share of them that is filled."""
    capacity = _capacity(spark, sf_dir)
    per = packing.fill(_packed(spark, sf_dir))
    total = F.sum("filled")
    return per.agg(F.count("*").alias("containers"), F.ceil(total / capacity).alias("least"), (total / (F.count("*") * capacity)).alias("filled_share"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the packing had to split."""
    return _packed(spark, sf_dir).where("n_pieces > 1").select(F.col("id").alias("doc_id")).distinct()


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, sf_dir, "documents")
    sized = mixing.sized_sources(documents, tokens.with_tokens(documents, ["doc_id", "source"], "text"))
    return sized, stored(mixing.plan(sized, table(spark, sf_dir, "mix_targets")), "plan")


def p8_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of every mix and how often each is used."""
    sized, planned = _mixed(spark, sf_dir)
    return mixing.draw(sized, planned).select("mix_id", F.col("id").alias("doc_id"), "source", "tokens", "copies")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted and reached share of every source of every mix."""
    sized, planned = _mixed(spark, sf_dir)
    return mixing.shares(planned, mixing.draw(sized, planned))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that cannot reach their target within the allowed repeats."""
    return _mixed(spark, sf_dir)[1].where("short").select("mix_id", "source")


def _levels(spark: SparkSession, sf_dir: str, only_english: bool = False) -> DataFrame:
    """(doc_id, level, status) of every document, or of the English ones; see ``reading.judged``."""
    documents = table(spark, sf_dir, "documents")
    model = reading.train(documents, table(spark, sf_dir, "reading_labels"))
    return reading.judged(documents.where(reading.english(F.col("lang"))) if only_english else documents, model)


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading level of every document; null, with the reason as status, where the model cannot judge it."""
    return _levels(spark, sf_dir)


def p9_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of documents by status and school grade; the grade is null where there is no level."""
    grade = F.when(F.col("level").isNotNull(), F.greatest(F.round("level").cast("int"), F.lit(0)))
    return p9_levels(spark, sf_dir).groupBy("status", grade.alias("grade")).agg(F.count("*").alias("n_documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents whose prose reads at grade 13 or above."""
    return _levels(spark, sf_dir, only_english=True).where("level >= 13").select("doc_id").distinct()


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_clean_text, p3_found, p3_classes, p4_found, p4_pieces, p6_found, p6_canonical, p7_found, p7_containers, p7_fill, p8_found, p8_selection, p8_shares, p9_found, p9_levels, p9_profile,
    )
}

_ITEMS = "select 'blocks' as item_table, block_id as item_id, content as text from blocks union select 'chunks', row_id, text from chunks"
_PASSAGES = """select 'blocks' as item_table, block_id as id, content as text from blocks where content is not null
union select 'selectors', selector_id, concat_ws(' ', coalesce(prefix, ''), coalesce(quote, ''), coalesce(suffix, '')) from selectors"""
# Bags of words of every class of equal texts, and the common words of every pair that shares any: brute force.
_ALIKE = rf"""with items as ({_PASSAGES}), members as (select item_table, id, min(id) over (partition by item_table, text) as class_id, text from items),
heads as (select item_table, id, list_filter(regexp_split_to_array(lower(text), '[^\pL\pN]+'), lambda w: w <> '') as ws from members where id = class_id),
sized as (select item_table, id, len(ws) as n, ws from heads), counted as (select item_table, id, n, w, count(*) as k from (select item_table, id, n, unnest(ws) as w from sized where n >= 20) group by all),
common as (select a.item_table, a.id as a, b.id as b, any_value(a.n) as n_a, any_value(b.n) as n_b, sum(least(a.k, b.k)) as c from counted a join counted b on a.item_table = b.item_table and a.w = b.w and a.id < b.id group by 1, 2, 3),
links as (select item_table, a, b from common where 10 * c >= 7 * (n_a + n_b - c)),
named as (select m.item_table, m.id, m.class_id, n from members m join sized s on s.item_table = m.item_table and s.id = m.class_id)"""
_BLANK = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _longest(pieces: str) -> str:
    """Code points of the longest of a list of texts, trimmed."""
    return f"list_max(list_transform({pieces}, lambda x: length(trim(x, {_BLANK}))))"


# Texts are cut at paragraphs by a walk over their lines that knows whether it stands in a code fence.
_CUTS = rf"""with recursive items as ({_ITEMS}),
big as (select i.item_table, item_id, regexp_replace(text, '\r\n?', chr(10), 'g') as t, max_size - overlap as most from items i join (select distinct item_table, max_size, overlap from size_limits where unit = 'chars') s on s.item_table = i.item_table where length(text) > max_size),
numbered as (select item_table, item_id, most, string_split(t, chr(10)) as ls from big),
walk as (
  select item_table, item_id, most, ls, 0 as i, '' as fence, false as blank from numbered
  union all
  select item_table, item_id, most, ls, i + 1,
    case when fence = '' and regexp_matches(ls[i + 1], '^ {{0,3}}(`{{3,}}[^`]*|~{{3,}}.*)$') then regexp_extract(ls[i + 1], '^ {{0,3}}(`{{3,}}|~{{3,}})', 1)
         when fence <> '' and regexp_matches(ls[i + 1], '^ {{0,3}}(`{{3,}}|~{{3,}})[ \t]*$') and left(trim(ls[i + 1]), 1) = left(fence, 1) and length(trim(ls[i + 1], ' ' || chr(9))) >= length(fence) then '' else fence end,
    fence = '' and trim(ls[i + 1], {_BLANK}) = ''
  from walk where i < len(ls)),
parts as (select item_table, item_id, most, ls[i] as l, i, sum(case when blank then 1 else 0 end) over (partition by item_table, item_id order by i) as part from walk where i > 0),
paragraphs as (select item_table, item_id, max(length(trim(x, {_BLANK}))) as longest from (select item_table, item_id, part, string_agg(l, chr(10) order by i) as x from parts group by 1, 2, 3) group by 1, 2)"""

SQL: dict[str, str] = {
    "p3_found": _ALIKE + """, pairs as (select l.item_table, least(x.id, y.id) as id_a, greatest(x.id, y.id) as id_b from links l join named x on x.item_table = l.item_table and x.class_id = l.a join named y on y.item_table = l.item_table and y.class_id = l.b)
select item_table, id_a, id_b from pairs union select x.item_table, x.id, y.id from named x join named y on x.item_table = y.item_table and x.class_id = y.class_id and x.id < y.id where x.n >= 20""",
    "p3_classes": _ALIKE + """, sizes as (select item_table, class_id, count(*) as n, any_value(n) as words from named group by 1, 2),
both_ways as (select item_table, a, b from links union all select item_table, b, a from links),
others as (select w.item_table, w.a as class_id, sum(s.n) as others from both_ways w join sizes s on s.item_table = w.item_table and s.class_id = w.b group by 1, 2)
select m.item_table, m.id as item_id, m.class_id, cast(coalesce(others, 0) + case when words >= 20 then s.n - 1 else 0 end as bigint) as n_links from named m join sizes s on s.item_table = m.item_table and s.class_id = m.class_id left join others o on o.item_table = m.item_table and o.class_id = m.class_id""",
    "p4_found": _CUTS + rf"""
select item_table, item_id, case when longest <= most then 'paragraph' when {_longest("string_split(t, chr(10))")} <= most then 'line'
  when {_longest(r"regexp_split_to_array(regexp_replace(regexp_replace(t, '([.!?])[ \t]', '\1' || chr(10), 'g'), '。', '。' || chr(10), 'g'), '\n')")} <= most then 'sentence'
  when {_longest(r"regexp_split_to_array(t, '[ \t\n]+')")} <= most then 'word' else 'char' end as boundary from big join paragraphs using (item_table, item_id)""",
    # the shares leave room for the choice of a unit, so that code points stand for tokens
    "p8_found": """with sized as (select lower(trim(source)) as source, sum(length(text)) as own from documents where source is not null group by 1), total as (select sum(own) as total from sized),
targets as (select mix_id, lower(trim(source)) as source, target_weight / sum(target_weight) over (partition by mix_id) * size_ratio as share, max_repeats from mix_targets)
select mix_id, t.source from targets t cross join total left join sized s on s.source = t.source where share * total > coalesce(own, 0) * max_repeats""",
    # no document is near the limit, so that four code points stand for a token
    "p7_found": "select doc_id from documents where length(text) / 4 > (select min(max_size) from size_limits where item_table = 'documents' and unit = 'tokens')",
}
