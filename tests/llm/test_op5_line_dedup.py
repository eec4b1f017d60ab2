import pytest

from docvet.llm.op5_line_dedup import drop_boilerplate_lines, page_key
from pyspark.sql import functions as F
from tests.llm.helpers import DOCS, awkward_docs


def tables():
    docs = awkward_docs()
    for i in range(60):
        host = None if i % 7 == 0 else "big" if i % 3 else "s1"
        lines = [f"own line {i}", "", "  All rights reserved " if i % 2 else "All rights reserved", f"half {i % 2}", f"few {i // 20}", "All rights reserved"]
        docs.append((1000 + i, "\n".join(lines), "en", host, None))
    docs += [(2000, "lonely\nlonely", "en", "tiny", 1), (2001, "lonely", "en", "tiny", 1)]
    return docs


def brute(docs, ratio, least, groups=None):
    """``groups``: what each row counts as, on its host; by default every row is a page."""
    groups = range(len(docs)) if groups is None else groups
    total, pages = {}, {}
    for (_, text, _, host, _), group in zip(docs, groups, strict=True):
        total.setdefault(host, set()).add(group)
        for line in {x.strip(" ") for x in (text or "").split("\n")} - {""}:
            pages.setdefault((host, line), set()).add(group)
    total, pages = ({k: len(v) for k, v in d.items()} for d in (total, pages))
    out = []
    for key, text, _, host, _ in docs:
        if text is None:
            out.append((str(key), None, 0, 0))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if not x.strip(" ") or not (pages[host, x.strip(" ")] >= least and pages[host, x.strip(" ")] > total[host] * ratio)]
        out.append((str(key), "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bound", [1000, -1])
@pytest.mark.parametrize("ratio", [0.05, 0.4])
def test_both_paths_match_brute_force(spark, bound, ratio):
    docs = tables()
    frame = spark.createDataFrame([(*d, "x", 2) for d in docs], DOCS + ", host string, key int")
    got = drop_boilerplate_lines(frame, max_ratio=ratio, broadcast_lines=bound)
    assert got.columns == [*frame.columns, "n_lines", "n_dropped"]
    assert sorted(((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=str) == brute(docs, ratio, 3)


def test_empty(spark):
    assert drop_boilerplate_lines(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("bound", [1000, -1])
def test_distinct_texts_count_once(spark, bound):
    docs = tables() + [(3000 + i, "clean one\nclean two", "en", "big", 1) for i in range(30)]
    # brute force over one row per text of a host
    once = [(n, *d[1:]) for n, d in enumerate({(d[3], d[1]): d for d in docs}.values())]
    text = {(once[int(n)][3], once[int(n)][1]): row for n, *row in brute(once, 0.05, 3)}
    got = drop_boilerplate_lines(spark.createDataFrame(docs, DOCS), broadcast_lines=bound, distinct_texts=True).collect()
    assert sorted(((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in got), key=str) == sorted(((str(d[0]), *text[d[3], d[1]]) for d in docs), key=str)
    assert {r.text for r in got if r.doc_id and r.doc_id >= 3000} == {"clean one\nclean two"} and any(r.n_dropped for r in got)


@pytest.mark.parametrize("bound", [1000, -1])
def test_groups_count_once(spark, bound):
    """Near copies on a third of a host: their lines are no boilerplate, one page's own line stays the one page's."""
    docs = tables() + [(3000 + i, f"clean one\nclean two\nnumber {i}" + "\nfew 0" * (i % 2), "en", "big", 1) for i in range(30)]
    group = lambda text: "copies" if (text or "").startswith("clean") else text
    frame = spark.createDataFrame(docs, DOCS)
    texts = frame.select("text", F.when(F.col("text").startswith("clean"), "copies").otherwise(F.col("text")).alias("group"))
    names = texts.select(page_key(F.col("text")).alias("page"), "group").distinct()
    got = drop_boilerplate_lines(frame, broadcast_lines=bound, groups=names).collect()
    assert sorted(((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in got), key=str) == brute(docs, 0.05, 3, [group(d[1]) for d in docs])
    assert all(r.n_dropped == 0 or "few 0" not in r.text for r in got if (r.doc_id or 0) >= 3000)
    assert sum("clean one\nclean two" in (r.text or "") for r in got) == 30
