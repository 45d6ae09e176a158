"""Operators over a text model: expansion, extraction, verdicts, reports.

A model is a callable from a batch of prompts to as many answers (None where it has none). It runs where the rows are, in
Arrow batches; whatever it raises or leaves out falls back as each operator says. Without a network, a stand-in does.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import judged_good, listed_queries, not_blank, strip, unfenced_json
from .chunk import strategy_of, text_windows
from .graph import with_verdicts
from .stores import rank_within
from .web import keep_first, listing_key

Model = Callable[[list[str]], list[str | None]]
#: Prompts that a model is given at once, at most.
ASKED = 256


def asked(rows: DataFrame, prompt: Column, into: str, model: Model) -> DataFrame:
    """rows with the model's answers; a batch on which it fails has null answers. A batch has ASKED prompts at most, and only
    its prompts are Python's strings at a time, however long they are."""

    @F.arrow_udf("string")
    def batch(prompts: pa.Array) -> pa.Array:
        answers = [pa.array([], pa.string())]
        for at in range(0, len(prompts), ASKED):
            part = prompts.slice(at, ASKED)
            try:
                said = pa.array(list(model(["" if p is None else p for p in part.to_pylist()])), pa.string())
                answers.append(said if len(said) == len(part) else pa.nulls(len(part), pa.string()))
            except Exception:  # noqa: BLE001  a model's failure is a missing answer here
                answers.append(pa.nulls(len(part), pa.string()))
        return pa.concat_arrays(answers)

    return rows.withColumn(into, batch(prompt))


def _refused(text: Column, what: str) -> Column:
    return F.when(not_blank(text), text).otherwise(F.raise_error(F.lit(what)).cast("string"))


def expanded_queries(queries: DataFrame, model: Model | None, n: int = 3, key: str = "query_id", text: str = "text") -> DataFrame:
    """LLM-02: (key, position, text): a query and its rewordings by the model, distinct; alone if the model fails.

    A blank query is an error. The original stands first.
    """
    checked = queries.select(key, _refused(F.col(text), "a blank query").alias("q"))
    if model is None:
        return checked.select(key, F.lit(0).alias("position"), F.col("q").alias(text))
    prompt = F.concat(F.lit(f"Write {n} other wordings of this search query, one a line:\n"), "q")
    rows = asked(checked, prompt, "answer", model)
    more = F.coalesce(listed_queries(F.col("answer"), n), F.array().cast("array<string>"))
    return rows.select(key, F.posexplode(F.array_distinct(F.concat(F.array("q"), more))).alias("position", text))


def drafts(queries: DataFrame, model: Callable[[list[str], float], list[str | None]], n: int = 1, key: str = "query_id", text: str = "text") -> DataFrame:
    """LLM-03: (key, position, draft): n made-up passages that would answer the query, each bolder than the one before;
    their vectors search in its place. A draft that fails is the query itself."""
    checked = queries.select(key, _refused(F.col(text), "a blank query").alias("q"))
    out = None
    for i in range(n):
        bold = min(1.0, 0.5 + 0.2 * i)
        prompt = F.concat(F.lit("Write a short passage that answers this question:\n"), "q")
        one = asked(checked, prompt, "draft", lambda prompts, bold=bold: model(prompts, bold))
        one = one.select(key, F.lit(i).alias("position"), F.when(not_blank(F.col("draft")), strip(F.col("draft"))).otherwise(F.col("q")).alias("draft"))
        out = one if out is None else out.unionByName(one)
    return out


#: Characters of a page and of a post query: fixed values.
PAGE_CHARS, POST_QUERY_CHARS = 10_000, 512
MOST_FACTS = 10


def extracted(pages: DataFrame, model: Model, schema: str, text: str = "text", into: str = "data", attempts: int = 2) -> DataFrame:
    """LLM-04: pages with a struct by the schema (a DDL string), read from the model's JSON; null if no attempt parses.

    The model sees the schema and the page's first PAGE_CHARS characters, and from the second attempt on what it said
    before. Only rows without a result are asked again. A page without text isn't asked for. Where a batch fails its rows are
    asked one by one, so that a page on which the model fails takes no other's result.
    """

    def replies(prompts: list[str]) -> list[str | None]:
        try:
            return list(model(prompts))
        except Exception:  # noqa: BLE001
            return [None] if len(prompts) == 1 else [r for p in prompts for r in replies([p])]

    @F.pandas_udf("string")
    def ask_again(prompts: pd.Series) -> pd.Series:
        said: list[str | None] = [None] * len(prompts)
        open_rows, now = [i for i, p in enumerate(prompts) if isinstance(p, str)], prompts.tolist()
        for _ in range(attempts):
            if not open_rows:
                break
            left = []
            for i, answer in zip(open_rows, replies([now[i] for i in open_rows])):
                bare = (answer or "").strip().removeprefix("```json").removeprefix("```").removesuffix("```").strip()
                try:
                    json.loads(bare)
                    said[i] = bare
                except ValueError:
                    now[i] += f"\n\nThis answer was not valid JSON, write it again:\n{answer}"
                    left.append(i)
            open_rows = left
        return pd.Series(said, dtype=object)

    prompt = F.concat(F.lit(f"Fill this schema from the page, as JSON: {schema}\n\n"), F.substring(text, 1, PAGE_CHARS))
    return pages.withColumn(into, F.from_json(ask_again(prompt), schema))


def described(schema: str) -> str:
    """FN-23: a schema (a DDL string) as a list of fields for a prompt."""
    from pyspark.sql.types import StructType

    return "\n".join(f"- {f.name} ({f.dataType.simpleString()}{'' if f.nullable else ', required'})" for f in StructType.fromDDL(schema))


def grounded_entities(chunks: DataFrame, model: Model, key: str = "chunk_id", text: str = "content", window: int = 1000, overlap: int = 0) -> DataFrame:
    """LLM-06: (key, position, kind, text, start, end): entities that the model names, found again in their chunk.

    The chunk is read in windows; the model answers each with a JSON list of (kind, text). An entity's place in its window
    is moved by the window's start; one that isn't in the window has null places. Windows that overlap may name one twice.
    """
    rows = chunks.select(key, F.posexplode(text_windows(F.col(text), window, overlap)).alias("w", "x")).select(key, "w", F.col("x.start").alias("base"), F.col("x.content").alias("part"))
    rows = asked(rows, F.concat(F.lit("List the entities of this text as JSON, with kind and text:\n"), "part"), "answer", model)
    found = F.from_json(unfenced_json(F.col("answer")), "array<struct<kind:string,text:string>>")
    rows = rows.select(key, "w", "base", "part", F.posexplode(found).alias("i", "e")).where("e.text is not null and e.text != ''")
    at = F.instr(F.col("part"), F.col("e.text"))
    start = F.when(at > 0, F.col("base") + at - 1)
    position = F.row_number().over(W.partitionBy(key).orderBy("w", "i")) - 1
    return rows.select(key, position.alias("position"), F.col("e.kind").alias("kind"), F.col("e.text").alias("text"), start.alias("start"), (start + F.length("e.text")).alias("end"))


def relation_triples(chunks: DataFrame, model: Model, key: str = "chunk_id", text: str = "content", most: int | None = None) -> DataFrame:
    """LLM-07: (key, position, subject, predicate, object): the relations that the model reads, complete ones only.

    The model reads whole texts, however long, and all that it names counts, or the first ``most`` of a text.
    """
    prompt = F.concat(F.lit("List the relations of this text as JSON, with subject, predicate and object:\n"), text)
    rows = asked(chunks.select(key, text), prompt, "answer", model)
    found = F.from_json(unfenced_json(F.col("answer")), "array<struct<subject:string,predicate:string,object:string>>")
    whole = F.filter(found, lambda t: not_blank(t["subject"]) & not_blank(t["predicate"]) & not_blank(t["object"]))
    return rows.select(key, F.posexplode(whole if most is None else F.slice(whole, 1, most)).alias("position", "t")).select(key, "position", "t.*")


def chosen_strategies(docs: DataFrame, model: Model, name: str = "path", text: str = "text") -> DataFrame:
    """LLM-08, CHK-14: docs with the chunker that the model names for their first characters (hierarchical if unclear)."""
    prompt = F.concat(F.lit("Which chunker suits this text: hierarchical, semantic, sentence or sliding_window?\n"), F.substring(text, 1, 1000))
    return asked(docs, prompt, "_answer", model).withColumn("strategy", strategy_of(F.col(name), F.coalesce("_answer", F.lit("")))).drop("_answer")


def relevant_pages(pages: DataFrame, goal: str, model: Model, text: str = "text") -> DataFrame:
    """LLM-09, FLT-15: pages with ``relevant``; an unclear or missing verdict keeps."""
    prompt = F.concat(F.lit(f"Does this page help with: {goal}? Answer GOOD or BAD.\n"), F.substring(text, 1, PAGE_CHARS))
    return asked(pages, prompt, "_answer", model).withColumn("relevant", F.coalesce(judged_good(F.col("_answer")), F.lit(True))).drop("_answer")


def gathered_listings(pages: DataFrame, model: Model, url: str = "url", text: str = "text", order: str = "position", shortest: int = 80) -> DataFrame:
    """LLM-11, SET-03: (listing_url, title, price, status, page): the listings of all pages, the first of each url.

    Pages with fewer than ``shortest`` characters aren't asked about, and listings without a url don't count.
    """
    rows = asked(pages.where(F.length(text) >= shortest), F.concat(F.lit("List the offers on this page as JSON, with url, title, price and status:\n"), F.substring(text, 1, PAGE_CHARS)), "answer", model)
    found = F.from_json(unfenced_json(F.col("answer")), "array<struct<url:string,title:string,price:string,status:string>>")
    rows = rows.select(F.col(url).alias("page"), F.col(order).alias("o"), F.posexplode(found).alias("i", "l")).where(not_blank(F.col("l.url")))
    rows = rows.select("page", F.struct("o", "i").alias("at"), F.col("l.url").alias("listing_url"), "l.title", "l.price", "l.status")
    return keep_first(rows, listing_key(F.col("listing_url"), fold=False), F.col("at")).select("listing_url", "title", "price", "status", "page")


def validated_items(items: DataFrame, model: Model, key: str, text: str, group: str, size: int = 20) -> DataFrame:
    """LLM-12, JON-10: items with passed and reason, judged ``size`` (1 to 50) at a time; without a verdict they fail.

    The model answers a numbered list of items with a JSON list of (index from 0, passed, reason).
    """
    size = min(max(size, 1), 50)
    numbered = rank_within(items, [group], [F.col(key)]).withColumn("_batch", F.floor((F.col("rank") - 1) / size)).withColumn("_index", ((F.col("rank") - 1) % size).cast("int"))
    line = F.concat(F.col("_index").cast("string"), F.lit(". "), F.coalesce(text, F.lit("")))
    batches = numbered.groupBy(group, "_batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_index", line.alias("l")))), lambda x: x["l"]), "\n").alias("list"))
    batches = asked(batches, F.concat(F.lit("Judge each item as JSON, with index, passed and reason:\n"), "list"), "answer", model)
    verdicts = batches.select(group, "_batch", F.inline(F.from_json(unfenced_json(F.col("answer")), "array<struct<index:int,passed:boolean,reason:string>>")))
    verdicts = verdicts.select(group, "_batch", F.col("index").alias("_index"), "passed", "reason").dropDuplicates([group, "_batch", "_index"])
    return with_verdicts(numbered.drop("rank"), verdicts, [group, "_batch", "_index"]).drop("_batch", "_index")


def summaries(pages: DataFrame, model: Model | None, text: str = "text", into: str = "summary", size: int = 500) -> DataFrame:
    """LLM-13: pages with a summary by the model, or their first characters where it has none."""
    short = F.substring(strip(F.col(text)), 1, size)
    if model is None:
        return pages.withColumn(into, short)
    rows = asked(pages, F.concat(F.lit("Summarise in a few sentences:\n"), F.substring(text, 1, PAGE_CHARS)), "_answer", model)
    return rows.withColumn(into, F.when(not_blank(F.col("_answer")), strip(F.col("_answer"))).otherwise(short)).drop("_answer")


#: The kinds of report and what each asks for.
REPORTS = {"summary": "a short summary", "detailed": "a detailed report with sections", "list": "a list of findings", "comparison": "a comparison in a table"}


def report(pages: DataFrame, model: Model, group: str, order: str, kind: str = "summary", text: str = "text", size: int = 8) -> DataFrame:
    """LLM-13, AGG-12: (group, report): pages are read ``size`` at a time, each batch is summarised, and the summaries
    become one report of the kind; where the model fails, the joined summaries are the report."""
    what = REPORTS[kind]
    ranked = rank_within(pages, [group], [F.col(order)]).withColumn("_batch", F.floor((F.col("rank") - 1) / size))
    joined = lambda o, t, between: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(o).alias("o"), F.col(t).alias("t")))), lambda x: x["t"]), between)
    batches = ranked.withColumn("_part", F.substring(text, 1, PAGE_CHARS // size)).groupBy(group, "_batch").agg(joined("rank", "_part", "\n\n").alias("all"))
    parts = summaries(batches, model, "all", "part")
    whole = parts.groupBy(group).agg(joined("_batch", "part", "\n\n").alias("all"))
    rows = asked(whole, F.concat(F.lit(f"Write {what} of these notes:\n"), "all"), "answer", model)
    return rows.select(group, F.when(not_blank(F.col("answer")), strip(F.col("answer"))).otherwise(F.col("all")).alias("report"))


def post_queries(goals: DataFrame, model: Model | None, text: str = "text", into: str = "query") -> DataFrame:
    """LLM-14: a search query for posts: the first line of the answer, at most POST_QUERY_CHARS; else the goal itself."""
    rows = goals.withColumn("_answer", F.lit(None).cast("string")) if model is None else asked(goals, F.concat(F.lit("Write one search query for posts about:\n"), text), "_answer", model)
    first = strip(F.split(strip(F.col("_answer")), "\n")[0])
    return rows.withColumn(into, F.substring(F.when(not_blank(first), first).otherwise(F.col(text)), 1, POST_QUERY_CHARS)).drop("_answer")


def new_queries(tried: list[str], proposed: list[str], most: int) -> list[str]:
    """SET-07: proposals that differ, without case and outer space, from each other and from what was tried."""
    seen, out = {q.strip().casefold() for q in tried}, []
    for q in proposed:
        key = q.strip().casefold()
        if key and key not in seen:
            seen.add(key)
            out.append(q.strip())
    return out[:most]


class Planner:
    """LLM-10: what to search for, when to go on and what to search next; driver-side, for one goal at a time.

    ``complete`` answers one prompt. Every answer has a fallback, so that a run goes on without the model.
    """

    def __init__(self, complete: Callable[[str], str | None]):
        self.complete = complete

    def _said(self, prompt: str) -> str:
        try:
            return self.complete(prompt) or ""
        except Exception:  # noqa: BLE001
            return ""

    @staticmethod
    def _lines(answer: str) -> Iterator[str]:
        for line in answer.splitlines():
            bare = line.strip().lstrip("-*•> ").strip()
            head, dot, rest = bare.partition(".")
            bare = rest.strip() if dot and head.isdigit() else bare
            if bare:
                yield bare

    def plan(self, goal: str, most: int = 5) -> list[str]:
        """The first queries; the goal itself if there is no answer."""
        return list(self._lines(self._said(f"Write up to {most} search queries, one a line, for: {goal}")))[:most] or [goal]

    def go_on(self, goal: str, found: str) -> bool:
        """Whether what was found calls for more; no answer says no."""
        return self._said(f"Goal: {goal}\nFound so far:\n{found}\nIs more needed? Answer YES or NO.").strip().upper().startswith("YES")

    def more(self, goal: str, tried: list[str], found: str, most: int = 3) -> list[str]:
        """Queries that differ from those tried (SET-07)."""
        said = self._said(f"Goal: {goal}\nTried:\n" + "\n".join(tried) + f"\nFound:\n{found}\nWrite up to {most} other queries, one a line.")
        return new_queries(tried, list(self._lines(said)), most)
