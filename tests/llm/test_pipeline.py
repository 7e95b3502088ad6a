import hashlib
import re
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline as pipeline  # noqa: E402

from gapwright.llm import langid  # noqa: E402
from test_text_operators import plain_components, plain_contaminated, plain_scores, plain_simhash  # noqa: E402


@pytest.fixture
def folder(spark, docs_of, odd, tmp_path):
    base = "one two three four five six seven eight nine ten " * 3
    rows = [(i, f"{base} number{i} alpha{i} beta{i} gamma{i} mail{i}@x.org {i * 7} " + " ".join(f"u{i}x{j}" for j in range(40)), "en") for i in range(10, 30)]
    rows += [(40, rows[0][1], "en"), (41, "item words here are these ones " + rows[3][1][-200:], "en"), (42, "123 456", None)]
    docs_of([*rows, *odd]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "item words here are these ones")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def plain_permuted(text, tweak, key=b"corpus-pipeline"):
    """Letters and digits of a text as one number, through eight Feistel rounds, until it is small enough."""
    radix = [10 if c.isdigit() else 26 if c.isalpha() else 1 for c in text]
    size, x = 1, 0
    for c, r in zip(text.lower(), radix, strict=True):
        size *= r
        x = x * r + (0 if r == 1 else ord(c) - ord("0" if r == 10 else "a"))
    if size == 1:
        return text
    bits = max(1, ((size - 1).bit_length() + 1) // 2)
    wide = (bits + 7) // 8
    while True:
        a, b = divmod(x, 1 << bits)
        for i in range(8):
            h = hashlib.shake_256(bytes([len(key)]) + key + f"{tweak}|{size}|".encode() + bytes([i]) + b.to_bytes(wide, "big")).digest(wide)
            a, b = b, a ^ int.from_bytes(h, "big") % (1 << bits)
        x = (a << bits) + b
        if x < size:
            break
    out = []
    for c, r in zip(reversed(text), reversed(radix), strict=True):
        x, d = divmod(x, r)
        out.append(c if r == 1 else chr(ord("0" if r == 10 else "a") + d))
    return "".join(reversed(out))


def plain_pseudonyms(text):
    return re.sub(r"(mail\d+)@(x)\.org", lambda m: f"{plain_permuted(m[1], 'local')}@{plain_permuted(m[2], 'host')}.org", text)


def test_run_equals_plain_stages(spark, folder):
    """No function of the library: regular expressions, all pairs, the model file."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    groups = {}
    for row, root in zip(kept, plain_components([plain_simhash(t) for _, t in kept]), strict=True):
        groups.setdefault(root, []).append((row[0] is None, row[0] or 0, row[1]))
    firsts = [(None if none else i, t) for none, i, t in (min(g) for g in groups.values())]
    clean = [(i, t) for i, t in firsts if not plain_contaminated([(i, t)], [(1, "item words here are these ones")])]
    assert len(clean) == len(firsts) - 1
    want = []
    for i, t in clean:
        new = plain_pseudonyms(t)
        assert (new != t) == ("@" in t)
        scores, n = plain_scores(new, 3)
        want.append((str(i), [round(x, 3) for x in scores], True))
    got = sorted((str(r["doc_id"]), [round(x, 3) for x in r["scores"]], r["round_trip"]) for r in pipeline.run(spark, folder).collect())
    assert got == sorted(want)


def test_mixed_texts_without_a_main_language_go(spark, docs_of):
    words = {"aa": "kuma tole riva sand", "bb": "хата небо зима мова", "cc": "μέρα νύχτα θάλασσα γη"}
    rows = [(i, " ".join([w] * 10), lang) for i, (lang, w) in enumerate(list(words.items()) * 8)]
    rows += [(900, " ".join(words.values()), None), (901, words["aa"] + " " + words["aa"] + " хата", None), (902, "12 34", None), (903, None, None)]
    docs = docs_of(rows)
    kept = {r["doc_id"] for r in pipeline.language(spark, docs, "").collect()}
    assert kept == {i for i, *_ in rows} - {900, 902, 903}


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert 4 <= len(pipeline.STAGES) <= 5
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).schema.simpleString() == docs.schema.simpleString()
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and langid.UNKNOWN == "und"


def test_stages_leave_clashing_columns_alone(spark, folder):
    """Further columns named as the operators' own ones come back with their values."""
    names = ["own", "first_id", "first_key", "tkey", "fp", "root", "rank", "text_key", "lang_pred", "__key", "__n"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 41")
    docs = docs.select("*", *(F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert out.count() > 15 and all(r[n] == f"{n}{r['doc_id']}" for r in out.collect() for n in names), name
    assert pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()
