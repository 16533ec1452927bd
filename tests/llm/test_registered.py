"""Every registered query over the smallest tables: the contract's columns, and its rows by SQL or plain Python."""

import zlib

import brute
import pytest
from check_oracle import compare, connect

from fieldpulse.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"

# The contract's columns and types.
CONTRACT = {
    "op1_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op2_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op3_decontaminate": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op4_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op5_substring": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op6_imatch": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                  "near_edited double, near_next double",
    "op7_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_hilbert": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op10_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op11_whitening": "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double",
    "op12_html": "page_id bigint, url string, text string, n_chars bigint",
    "op13_fim": "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string",
}


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def results(spark):
    found = {}

    def rows(name):
        if name not in found:
            df = QUERIES[name](spark, FOLDER)
            found[name] = dict(df.dtypes), df.collect()
        return found[name]
    return rows


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_columns_of_the_contract(spark, results, name):
    kinds = dict(field.split(" ") for field in CONTRACT[name].split(", "))
    given = results(name)[0]
    ids = {k: v for k, v in kinds.items() if k in ("doc_id", "page_id", "vec_id")}  # ids keep the type of the table
    assert {k: given.get(k) for k in kinds if k not in ids} == {k: v for k, v in kinds.items() if k not in ids}
    assert all(given[k] in ("int", "bigint") for k in ids)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, QUERIES[name], ORACLE[name]) is None


def test_personal_data(results, docs):
    rows = results("op2_pii")[1]
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        spans = brute.base_spans(docs[r.doc_id])
        listed = [f"{kind}:{a}:{b}" for kind in ("email", "ip", "card", "phone") for a, b in spans[kind]]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(spans[k]) for k in ("email", "ip", "card", "phone")]
        assert r.base_sha256 == brute.sha(",".join(listed))
        assert set(listed) <= set(r.spans.split(","))


def test_benchmark_passages(spark, results, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    want = {d: (len(words), sum(hit), len(found), brute.sha(",".join(sorted(found))), any(hit))
            for d, words, hit, found in brute.benchmark_hits(docs.items(), items)}
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
            for r in results("op3_decontaminate")[1]} == want


def test_fingerprints_and_components(results, docs):
    prints = {d: brute.simhash(t) for d, t in docs.items()}
    root = brute.near_components(prints)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in results("op4_simhash")[1]} == {
        d: (f"{prints[d]:016x}", root[d]) for d in docs}


def test_repeated_passages(results, docs):
    want = {d: (len(words), sum(gone), brute.sha(" ".join(w for w, g in zip(words, gone) if not g)))
            for d, words, gone in brute.repeated_words(list(docs.items()))}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in results("op5_substring")[1]} == want


def test_edited_texts(results, docs):
    order = sorted(docs)
    rows = {r.doc_id: r for r in results("op6_imatch")[1]}
    assert sorted(rows) == order
    by_text = {}
    for d, after in zip(order, order[1:] + order[:1]):
        text, r = docs[d] or "", rows[d]
        cut = len(text) // 4
        edited = text[:len(text) - cut] + (docs[after] or "")[:cut]
        assert (r.n_chars, r.edited_sha256) == (len(text), brute.sha(edited))
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if edited == text:
            assert r.edited_fingerprint == r.fingerprint and r.near_edited == 1


@pytest.mark.parametrize("name, folds, held", [("op7_toxicity", 3, 1), ("op10_language", 5, 0)])
def test_folds_and_scores(results, docs, name, folds, held):
    rows = results(name)[1]
    assert {r.doc_id: r.held_out for r in rows} == {d: zlib.crc32(str(d).encode()) % folds == held for d in docs}
    assert all(0 <= r.score <= 1 for r in rows)
    if name == "op7_toxicity":
        assert all(r.predicted == int(r.score >= 0.7) for r in rows)


def test_one_law_of_shards(results, docs):
    rows = results("op8_hilbert")[1]
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {
        d: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs.items()}
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    counts = []
    for shard in range(16):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
        counts.append(len(slots))
    assert max(counts) - min(counts) <= 1
