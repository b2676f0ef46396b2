from __future__ import annotations

import pytest
import sentencepiece
from test_decontaminate import words_of
from test_minhash_forest import brute as components
from test_minhash_forest import sets_of

import corpus_pipeline as C
from colloquy.llm.pieces import VOCABULARY

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows after each stage, with odd rows put in front."""
    odd = [
        (100_001, None, "en", "s", 0), (100_002, "", None, None, None), (100_003, "12 345", "en", "s", 6),
        (None, "The thing of that and the other with for was on.", "en", None, 48),
    ]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id = 7")).unionByName(spark.createDataFrame(odd, docs.schema))
    out = {"documents": docs.collect()}
    folder = tmp_path_factory.mktemp("stages")
    for name, stage in C.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out[name] = docs.collect()
        if name != C.STAGES[-1][0]:
            assert docs.columns == COLUMNS
    return out


def test_language(stages):
    before, after = stages["documents"], stages["language_id"]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert {100_001, 100_002, 100_003} <= gone and len(gone) <= 4
    assert all(r in before for r in after)


def test_unlearned_language_goes(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    unlearned = docs.where("lang = 'de'").selectExpr("doc_id + 1000000 doc_id", "text", "cast(null as string) lang", "source", "n_chars")
    short = docs.where("lang != 'de'").selectExpr("doc_id + 2000000 doc_id", "array_join(slice(split(text, ' '), 10, 8), ' ') text", "cast(null as string) lang", "source", "n_chars").where(r"text rlike '\\p{L}'")
    noise = spark.createDataFrame([(3_000_000, "qxv jzkw pfgh wqqz bvnx kjhq zzxw vbkq", None, "s", 0)], docs.schema)
    rows = docs.where("lang != 'de'").unionByName(unlearned).unionByName(short).unionByName(noise)
    kept = [r.doc_id // 1_000_000 for r in C.identify_language(spark, rows, FOLDER).collect()]
    assert unlearned.count() > 20 and kept.count(1) == kept.count(3) == 0
    assert kept.count(0) >= docs.where("lang != 'de'").count() - 1
    assert kept.count(2) == short.count() > 100


def test_lines(stages):
    before, after = stages["language_id"], stages["line_dedup"]
    once = {tuple(r): r for r in after}.values()
    lines = [x for r in once for x in r.text.split("\n") if x.strip()]
    assert len(lines) == len(set(lines))
    assert {x for r in before for x in r.text.split("\n") if x.strip()} == set(lines)
    assert all(r.n_chars == len(r.text) for r in after)


def test_near_duplicates(stages):
    before, after = stages["line_dedup"], stages["near_duplicates"]
    named = [(r.doc_id, r.text) for r in before if r.doc_id is not None]
    keep = {i for i, _, c in components(named, C.SHINGLE_WORDS) if i == c}
    assert sorted(r.doc_id for r in after if r.doc_id is not None) == sorted(keep)
    assert sum(r.doc_id is None for r in after) == 1
    assert all(sets_of(r.text, C.SHINGLE_WORDS) for r in after)


def test_benchmark(spark, stages):
    before, after = stages["near_duplicates"], stages["decontamination"]
    windows = set()
    for item in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        w = words_of(item.text)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}

    def hit(text):
        w = words_of(text)
        return any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))

    texts = {r.doc_id: r.text for r in after}
    clean = [r for r in before if not hit(r.text)]
    assert all(texts[r.doc_id] == r.text for r in clean) and len(clean) < len(before)
    assert all(len(t) < len(r.text) for r in before if hit(r.text) and (t := texts.get(r.doc_id)) is not None)


def test_pieces(stages):
    model = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    texts = {r.doc_id: r.text for r in stages["decontamination"]}
    assert {r.doc_id: r.ids for r in stages["sentencepiece"]} == {i: model.encode(t) for i, t in texts.items()}
    assert all(r.round_trip for r in stages["sentencepiece"])


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "words", None, None, 5), (2, "1", None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in C.identify_language(spark, docs, FOLDER).collect()] == [1]
    for _, stage in C.STAGES:
        assert stage(spark, docs.limit(0), FOLDER).count() == 0


def test_language_is_learned_from_all_texts(spark, monkeypatch):
    """Words of one text among 4,000 of a language count; a sample by ids would leave out some of these texts."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, f"the thing of that and {chr(97 + i % 26) * 3}", "en", "s", 0) for i in range(4000)] + [(9999, "der das und ein", "de", "s", 0)]
    sizes = []
    learned = C.language_id.learned

    def counted(*given):
        found, n = learned(*given)
        sizes.append(found.count())
        return found, n

    monkeypatch.setattr(C.language_id, "learned", counted)
    C.identify_language(spark, spark.createDataFrame(rows, schema), FOLDER).count()
    assert sizes == [4001, 4001]
