"""Chunkers: table-valued functions from documents to chunks.

Each takes a DataFrame with a key and a text column and returns (key, chunk_index, content, ...), one row per chunk.
The greedy packers are folds inside one row; a fold copies its list of finished chunks only when it finishes one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import not_blank, sentences, strip

_PACKED = "struct<done:array<string>,buf:array<string>,len:int>"


def hard_slices(text: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size)), lambda i: F.substr(text, i + 1, F.lit(size)))


def _state(done: Column, buf: Column, length: Column) -> Column:
    return F.struct(done.alias("done"), buf.alias("buf"), length.cast("int").alias("len"))


def _empty() -> Column:
    return F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("buf"), F.lit(0).alias("len"))


def pack_sentences(parts: Column, most: int, least: int, glue: str = " ") -> Column:
    """CHK-06: sentences into chunks of at most ``most`` characters, separators not counted; a short tail joins the last chunk."""

    def step(s: Column, x: Column) -> Column:
        n, held = F.length(x), F.size(s["buf"]) > 0
        flush, slices = (s["len"] + n > most) & held, (n > most) & ~held
        return (
            F.when(flush, _state(F.array_append(s["done"], F.array_join(s["buf"], glue)), F.array(x), n))
            .when(slices, _state(F.concat(s["done"], hard_slices(x, most)), s["buf"], s["len"]))
            .otherwise(_state(s["done"], F.array_append(s["buf"], x), s["len"] + n))
        )

    def finish(s: Column) -> Column:
        tail, n = F.array_join(s["buf"], glue), F.size(s["done"])
        merged = F.concat(F.slice(s["done"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.try_element_at(s["done"], F.lit(-1)), F.lit(glue), tail)))
        return F.when(F.size(s["buf"]) == 0, s["done"]).when((F.length(tail) >= least) | (n == 0), F.array_append(s["done"], tail)).otherwise(merged)

    return F.aggregate(parts, _empty(), step, finish)


def pack_overlapping(parts: Column, most: int, overlap: int) -> Column:
    """CHK-07: as above, but a finished chunk's last sentences, as many as fit in ``overlap``, open the next one."""

    def carry(buf: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("len"), F.lit(True).alias("on"))

        def back(s: Column, x: Column) -> Column:
            fits = s["on"] & (s["len"] + F.length(x) <= overlap)
            return F.struct(F.when(fits, F.concat(F.array(x), s["kept"])).otherwise(s["kept"]).alias("kept"), F.when(fits, s["len"] + F.length(x)).otherwise(s["len"]).alias("len"), fits.alias("on"))

        return F.aggregate(F.reverse(buf), start, back)

    def add(done: Column, buf: Column, length: Column, x: Column) -> Column:
        n = F.length(x)
        return F.when((n > most) & (F.size(buf) == 0), _state(F.concat(done, hard_slices(x, most)), buf, length)).otherwise(_state(done, F.array_append(buf, x), length + n))

    def step(s: Column, x: Column) -> Column:
        flush = (s["len"] + F.length(x) > most) & (F.size(s["buf"]) > 0)
        kept = carry(s["buf"])
        return F.when(flush, add(F.array_append(s["done"], F.array_join(s["buf"], " ")), kept["kept"], kept["len"], x)).otherwise(add(s["done"], s["buf"], s["len"], x))

    return F.aggregate(parts, _empty(), step, lambda s: F.when(F.size(s["buf"]) > 0, F.array_append(s["done"], F.array_join(s["buf"], " "))).otherwise(s["done"]))


def fixed_windows(text: Column, size: int, overlap: int) -> Column:
    """CHK-08: windows of ``size`` characters, each ``overlap`` into the one before; the last ends with the text."""
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the window")
    n = F.length(text)
    last = F.greatest(F.ceil((n - size) / F.lit(float(size - overlap))).cast("int"), F.lit(0))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(text, i * (size - overlap) + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def _explode(docs: DataFrame, key: str, chunks: Column, name: str = "content") -> DataFrame:
    return docs.select(key, F.posexplode(chunks).alias("chunk_index", name))


def sentence_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 1000, least: int = 100) -> DataFrame:
    return _explode(docs.where(not_blank(F.col(text))), key, pack_sentences(sentences(F.col(text)), most, least))


def sliding_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 1000, overlap: int = 200, boundaries: bool = True) -> DataFrame:
    """CHK-07 to CHK-09: start_char is the running length less the overlaps; exact for fixed windows."""
    kept = docs.where(not_blank(F.col(text)))
    out = _explode(kept, key, pack_overlapping(sentences(F.col(text)), most, overlap) if boundaries else fixed_windows(F.col(text), most, overlap))
    before = F.coalesce(F.sum(F.length("content")).over(W.partitionBy(key).orderBy("chunk_index").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    start = before - F.col("chunk_index") * overlap
    return out.withColumn("start_char", start.cast("long")).withColumn("end_char", (start + F.length("content")).cast("long"))


def sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """CHK-03: one row per heading: section_index, title, level, start_char, end_char, content.

    Text before the first heading is dropped; a text without headings is one section ``Document`` of level 0.
    Headings are found in one pass over the text: it is cut before each of them, and positions are running lengths.
    """
    t = F.col(text)
    # a piece starts at a heading, but for the first, which ends where the first heading starts
    pieces = F.split(t, r"(?m)(?=^#{1,6}\s+[^\n]+)")
    rows = docs.where(not_blank(t)).select(key, F.posexplode(pieces).alias("p", "piece"))
    w = W.partitionBy(key).orderBy("p")
    rows = rows.withColumn("start_char", F.coalesce(F.sum(F.length("piece")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    head = r"(?s)\A(#{1,6})\s+([^\n]+)\n?(.*)\z"
    rows = rows.withColumn("level", F.length(F.regexp_extract("piece", head, 1))).withColumn("any", F.max("level").over(W.partitionBy(key)))
    plain = (F.col("any") == 0) & (F.col("p") == 0)
    rows = rows.where((F.col("level") > 0) | plain)
    return rows.select(
        key,
        (F.row_number().over(w) - 1).alias("section_index"),
        F.when(plain, F.lit("Document")).otherwise(strip(F.regexp_extract("piece", head, 2))).alias("title"),
        "level",
        "start_char",
        (F.col("start_char") + F.length("piece")).alias("end_char"),
        F.when(plain, F.col("piece")).otherwise(strip(F.regexp_extract("piece", head, 3))).alias("content"),
    )


def hierarchical_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 1000, max_depth: int = 5) -> DataFrame:
    """CHK-04 and CHK-05: sections, large ones packed by paragraphs, each with the index of its parent and its number of children.

    The parent is the last chunk before the section at the nearest lower level that was ever seen.
    """
    parts = F.when(F.length("content") > most, _paragraph_parts(F.col("content"), most)).otherwise(F.array("content"))
    rows = sections(docs, key, text).withColumn("level", F.least("level", F.lit(max_depth))).withColumn("parts", parts)
    rows = rows.select("*", F.posexplode("parts").alias("part", "body"))
    w = W.partitionBy(key).orderBy("section_index", "part")
    title = F.when(F.size("parts") > 1, F.concat("title", F.lit(" (part "), (F.col("part") + 1).cast("string"), F.lit(")"))).otherwise(F.col("title"))
    rows = rows.withColumn("chunk_index", (F.row_number().over(w) - 1).cast("int")).withColumn("title", title)
    # of the chunks before this section
    before = W.partitionBy(key).orderBy("section_index").rangeBetween(W.unboundedPreceding, -1)
    lower = [F.when(F.col("level") > k, F.max(F.when(F.col("level") == k, F.col("chunk_index"))).over(before)) for k in range(max_depth - 1, -1, -1)]
    rows = rows.withColumn("parent_index", F.coalesce(*lower))
    children = rows.where("parent_index is not null").groupBy(F.col(key), F.col("parent_index").alias("chunk_index")).agg(F.count("*").alias("n_children"))
    out = rows.select(key, "chunk_index", "title", "level", "parent_index", F.col("body").alias("content"), "start_char", "end_char").join(children, [key, "chunk_index"], "left")
    return out.withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))


def _paragraph_parts(content: Column, most: int) -> Column:
    def step(s: Column, x: Column) -> Column:
        n = F.length(x)
        flush = (s["len"] + n > most) & (F.size(s["buf"]) > 0)
        return F.when(flush, _state(F.array_append(s["done"], F.array_join(s["buf"], "\n\n")), F.array(x), n)).otherwise(_state(s["done"], F.array_append(s["buf"], x), s["len"] + n))

    return F.aggregate(F.split(content, "\n\n"), _empty(), step, lambda s: F.array_append(s["done"], F.array_join(s["buf"], "\n\n")))


def semantic_chunks(sentence_rows: DataFrame, key: str = "doc_id", order: str = "sent_idx", text: str = "sentence", similarity: str = "prev_sim", threshold: float = 0.7, most: int = 1000, least: int = 100) -> DataFrame:
    """CHK-10: sentences with their similarity to the one before -> chunks, cut where it drops or a chunk would overflow.

    A cut is only made once the chunk has ``least`` characters.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("i"), F.col(text).alias("t"), F.col(similarity).alias("s"))))

    def step(s: Column, x: Column) -> Column:
        n, held = F.length(x["t"]), F.size(s["buf"]) > 0
        cut = held & ((F.coalesce(x["s"], F.lit(1.0)) < threshold) | (s["len"] + n > most)) & (s["len"] >= least)
        return F.when(cut, _state(F.array_append(s["done"], F.array_join(s["buf"], " ")), F.array(x["t"]), n)).otherwise(_state(s["done"], F.array_append(s["buf"], x["t"]), s["len"] + n))

    packed = F.aggregate("all", _empty(), step, lambda s: F.when(F.size(s["buf"]) > 0, F.array_append(s["done"], F.array_join(s["buf"], " "))).otherwise(s["done"]))
    return sentence_rows.groupBy(key).agg(ordered.alias("all")).select(key, F.posexplode(packed).alias("chunk_index", "content"))


def text_windows(text: Column, size: int, overlap: int = 200) -> Column:
    """CHK-11: (start, content) windows for a model with a bounded input, without blank ones."""
    step = max(size - overlap, 1)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.length(text) - size) / F.lit(float(step))).cast("int"), F.lit(0)))
    windows = F.transform(starts, lambda i: F.struct((i * step).alias("start"), F.substr(text, i * step + 1, F.lit(size)).alias("content")))
    return F.filter(windows, lambda w: w["content"].rlike(r"\S"))


def last_above(rows: DataFrame, doc: str, order: str, value: Column, into: str) -> DataFrame:
    """WIN-03: the last value that isn't null before a row of its document, as a chunk finds its section's parent."""
    w = W.partitionBy(doc).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn(into, F.last(value, ignorenulls=True).over(w))


def section_ends(rows: DataFrame, doc: str, start: str, size: Column, end: int) -> DataFrame:
    """WIN-04, WIN-05: section_end, where the next section starts (or ``end``), and chars, the running sum of sizes."""
    w = W.partitionBy(doc).orderBy(start)
    return rows.withColumns({"section_end": F.lead(start, 1, end).over(w), "chars": F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0))})


def strategy_of(file_name: Column, answer: Column) -> Column:
    """CHK-14: the chunker named first of these in a model's answer; markdown files and unclear answers are hierarchical."""
    a = F.lower(answer)
    return (
        F.when(a.contains("hierarchical") | F.lower(file_name).endswith(".md"), "hierarchical")
        .when(a.contains("semantic"), "semantic")
        .when(a.contains("sentence"), "sentence")
        .when(a.contains("sliding"), "sliding_window")
        .otherwise("hierarchical")
    )
