import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm.packing import Packer, pack_documents
from lexmill.llm.rans import CHECKPOINT_STEPS, LANES, Coder, frequencies, read_ids, write_ids
from lexmill.llm.tokens import TextEncoder, tokenizer_path

PATH = tokenizer_path()
ENCODER = TextEncoder(PATH, memo_words=50)


def plain(text):
    return ENCODER.tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*" \n\t'abcABéñß12.,!*|日 \u0085\u180e\x1c", "<|endoftext|>", "don't", " the", "  "]), max_size=30).map("".join), max_size=5))
def test_memo_gives_the_librarys_ids(texts):
    ids, lens = ENCODER.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(lens)[:-1])] == [plain(t) for t in texts] if texts else not len(ids)


def test_corpus_ids_equal_the_librarys(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for enc in (ENCODER, TextEncoder(PATH)):
        ids, lens = enc.encode([*texts, None, ""])
        assert [x.tolist() for x in np.split(ids, np.cumsum(lens)[:-1])] == [plain(t) for t in [*texts, None, ""]]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 3 * LANES * CHECKPOINT_STEPS), st.integers(1, 2000))
def test_rans_round_trip(seed, n, symbols):
    rng = np.random.default_rng(seed)
    ids = np.minimum(rng.geometric(0.02, n) - 1, symbols - 1)
    freq = frequencies(np.bincount(ids, minlength=symbols))
    assert freq.sum() == 2**20
    coder = Coder(freq)
    blob = coder.encode(ids)
    assert (coder.decode(blob) == ids).all()
    marks = -(-n // (LANES * CHECKPOINT_STEPS))
    parts = [coder.decode(blob, k, k + 1 if k + 1 < marks else None) for k in range(marks)]
    assert (np.concatenate(parts) == ids).all()


def test_damage_is_found():
    coder = Coder(frequencies(np.ones(300)))
    blob = bytearray(coder.encode(np.arange(300)))
    blob[-3] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        coder.decode(bytes(blob))


ROWS = [(3, "alpha beta gamma", "x"), (1, None, "x"), (2, "", None), (2, "again", "y"), (None, "no id", "z"), (7, "w " * 3000 + "end", "x"), (3, "alpha beta gamma", "x")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, start string")


def crc(ids):
    import zlib

    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_files_keep_order_and_ids(spark, tmp_path):
    write_ids(frame(spark), spark, str(tmp_path / "f"))
    got = sorted(read_ids(spark, str(tmp_path / "f")).collect(), key=lambda r: r.start)
    want = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    for g, w in zip(got, want, strict=True):
        ids = [*plain(w[1]), 2]
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (w[0], at, len(ids), crc(ids))
        at += len(ids)


@pytest.mark.parametrize("split", ["40k", "128m"])
def test_files_ascend_in_the_order_of_their_names(spark, tmp_path, split):
    """Block files, read in name order without sorting, hold every id once and in order, for small scan splits and large ones."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5, "text")
    big = spark.createDataFrame([(50, "a b " * 300_000), (51, None), (10_000, "c")], "doc_id long, text string")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        write_ids(docs.select("doc_id", "text").union(big), spark, str(tmp_path / "g"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    files = sorted((tmp_path / "g" / "blocks").glob("part-*.parquet"))
    blocks = [r for f in files for r in pq.read_table(f).to_pylist()]
    assert len(files) > 1 and len(blocks) > len(files) / 2
    at, last = 0, -1
    for b in blocks:
        assert b["start"] == at and b["doc_ids"] == sorted(b["doc_ids"]) and b["doc_ids"][0] >= last
        at, last = at + sum(b["lengths"]), b["doc_ids"][-1]
    assert sum(len(b["doc_ids"]) for b in blocks) == docs.count() + 3
    assert read_ids(spark, str(tmp_path / "g")).count() == docs.count() + 3


def test_empty_table_of_ids(spark, tmp_path):
    write_ids(frame(spark, []), spark, str(tmp_path / "e"))
    assert read_ids(spark, str(tmp_path / "e")).count() == 0


def check_packing(rows, docs):
    """Every id in one piece, windows gapless and powers of two."""
    windows, pieces = {}, {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r)
    for parts in windows.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end and n > 0
            end += n
        assert end <= 1024 and end & (end - 1) == 0
    for doc_id, texts in docs.items():
        ids = [[*plain(t), 0] for t in texts]
        assert sum(p.length for p in pieces[doc_id]) == sum(map(len, ids))
        if len(texts) == 1:
            at = 0
            for p in sorted(pieces[doc_id], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(ids[0]) and p.ids_crc32 == crc(ids[0][at : at + p.length])
                at += p.length


def test_packing_odd_rows(spark):
    docs = {}
    for i, t, _ in ROWS:
        docs.setdefault(i, []).append(t)
    check_packing(pack_documents(frame(spark)).collect(), docs)
    assert pack_documents(frame(spark, [])).count() == 0


def test_packing_corpus(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check_packing(pack_documents(rows).collect(), {r.doc_id: [r.text] for r in rows.collect()})


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 3000), max_size=40))
def test_packer_loses_nothing_and_balances_steps(lengths):
    out = []
    packer = Packer(lambda *a: out.append(a), step_tokens=2048)
    for i, n in enumerate(lengths):
        packer.add(i, n, 0)
        if i % 7 == 0:
            packer.pack()
    packer.finish()
    assert packer.tokens == 0 and sum(a[2] for a in out) == sum(lengths)
    seen = sorted((a[0], a[1], a[1] + a[2]) for a in out)
    for x, y in zip(seen, seen[1:], strict=False):
        assert x[0] != y[0] or x[2] == y[1]
    groups = {}
    for a in out:
        groups[a[7]] = groups.get(a[7], 0) + a[2]
    assert all(v <= 2048 for v in groups.values())
