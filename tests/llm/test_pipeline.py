"""Each stage of the pipeline, on what its predecessor kept, against a plain version."""

import corpus_pipeline
from lodestrand.llm.common import materialize

from .test_cube_mix import plain_targets
from .test_decontaminate import plain as plain_cover
from .test_exact_dedup import lower
from .test_langid import Plain, learned
from .test_simhash_vptree import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "mixing"]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        rows = {r.doc_id: r for r in docs.collect()}
        kept = materialize(stage(spark, docs, SF), name)
        got = {r.doc_id for r in kept.collect()}
        assert kept.count() == len(got)
        if name == "language_id":
            plain_language = Plain(learned(docs))
            found = {i: plain_language(r.text) for i, r in rows.items()}
            want = {i for i, (lang, score) in found.items() if lang != "und" and score >= 0.5}
        elif name == "exact_dedup":
            last = {lower(r.text): i for i, r in sorted(rows.items())}
            want = set(last.values())
        elif name == "near_dedup":
            want = set(plain_components({i: plain_fingerprint(r.text) for i, r in rows.items()}).values())
        elif name == "decontamination":
            # only items whose middle is there word by word can be covered; those are searched in full
            middle = {t: " ".join(t.lower().split()[5:-5]) for t in bench}
            flat = {i: " ".join(r.text.lower().split()) for i, r in rows.items()}
            want = {i for i, r in rows.items() if not any(middle[t] and middle[t] in flat[i] and plain_cover(r.text, t) >= 0.8 for t in bench)}
        else:
            sizes = {}
            for r in rows.values():
                sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
            targets = plain_targets(sizes)
            taken = {}
            for r in kept.collect():
                assert 1 <= r.copies <= 3
                taken[r.source] = taken.get(r.source, 0) + r.copies * len(r.text.split())
            largest = max(len(r.text.split()) for r in rows.values())
            assert all(abs(taken.get(s, 0) - t) <= largest for s, t in targets.items()) and got <= set(rows)
            continue
        assert got == want, name
        assert kept.columns == columns
        docs = kept


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "lang", "source", "n_chars", "copies"} == set(out.columns) and out.count() > 20


ODD = "doc_id long, text string, lang string, source string, n_chars long, rid string, fp long, Copies int, _file string"


def odd_rows():
    words = ["the cat sat on the mat and looked at the dog", "der Hund lief durch den Wald und sah die Katze"]
    rows = [(i, f"{words[i % 2]} {' '.join(chr(97 + (i * 7 + k) % 26) * 3 for k in range(30))}", ("en", "de")[i % 2], f"s{i % 3}", 1, "x", None, 1, None) for i in range(40)]
    rows += [(None, words[0] + " without an id", "en", None, None, None, 1, None, "x"), (None, words[0] + " without an id", "en", None, None, None, 1, None, "x")]
    rows += [(50, None, "en", "s1", 0, "x", 1, 1, "x"), (51, "", None, "s1", 0, "x", 1, 1, "x"), (52, " \t\n", "en", None, 0, "x", 1, 1, "x"), (53, "123 !?", None, "s1", 0, "x", 1, 1, "x")]
    return rows + [(54, "the cat " * 40_000, "en", "s2", 0, "x", 1, 1, "x"), (55, "x" * 300_000, "en", "s2", 0, "x", 1, 1, "x"), rows[3], rows[3]]


def test_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), ODD)
    for given in (docs, docs.where("doc_id > 10000"), docs.repartition(3, "text")):
        now = given
        for name, stage in corpus_pipeline.STAGES:
            out = materialize(stage(spark, now, SF), name)
            assert [c.lower() for c in out.columns] == [c.lower() for c in docs.columns] or name == "mixing"
            assert {c.lower() for c in out.columns} == {c.lower() for c in docs.columns}
            before, after = now.collect(), out.collect()
            if given is not docs and not before:
                assert not after
            held = {(r.doc_id, r.text) for r in before}
            assert {(r.doc_id, r.text) for r in after} <= held, name
            if name == "language_id" and before:
                assert {r.doc_id for r in before} - {r.doc_id for r in after} >= {50, 51, 52, 53} and {54, None} <= {r.doc_id for r in after}
            elif name == "exact_dedup" and before:
                assert len(after) == len({lower(r.text) for r in before}) == len({r.text for r in after})
            elif name == "near_dedup" and before:
                assert len(after) <= len(before) and None in {r.doc_id for r in after} and 54 in {r.doc_id for r in after}
            elif name == "decontamination":
                assert len(after) == len(before)
            now = out
