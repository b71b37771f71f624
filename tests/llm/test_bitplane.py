import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from mtlens.llm import bitplane, queries

from .conftest import DOCS

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def encoder():
    return bitplane.Encoder(queries.token_file())


def test_planes_round_trip():
    rng = np.random.default_rng(1)
    for n in (1, 7, 8, 4099):
        ids = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
        for bits in (False, True):
            planes = bitplane.to_planes(ids, bits)
            assert len(planes) == (32 if bits else 4) and (bitplane.from_planes(planes, n) == ids).all()


def test_crc_of_joined_parts():
    rng = random.Random(2)
    for _ in range(50):
        a, b = rng.randbytes(rng.randint(0, 99)), rng.randbytes(rng.randint(0, 99))
        assert bitplane.crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_ids_equal_the_library_on_whole_texts(encoder):
    rng = random.Random(3)
    alphabet = "abAB zZ\t\n..,'s'tré ß12İΣςσ’́ \x85​#$中文한ǅªº٣\x1c_~^|<>"
    odd = ["<|endoftext|>", "<|startoftext|>", "don't", "it's.", "HELLO,", "<|ENDOFTEXT|>", "é", "İ", "i̇x", "the", "The"]
    texts = ["".join(rng.choice(alphabet) if rng.random() < 0.9 else " " + rng.choice(odd) + rng.choice(["", " ", ",", "'s"]) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    for _ in range(2):  # with a cold and a warm cache
        ids, offsets = encoder(pa.array([*texts, None, ""]))
        for i, e in enumerate(encoder.tokenizer.encode_batch([*texts, "", ""], add_special_tokens=False)):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == [*e.ids, 1]


@pytest.mark.parametrize("bits", [False, True])
def test_files_hold_all_ids_in_order(spark, prose, edge_rows, encoder, tmp_path, bits):
    rows = [(i * 3, prose(i % 50), "en", "s", 0) for i in range(120)] + edge_rows
    docs = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", shard int").repartition(5)
    bitplane.write_tokens(docs, str(tmp_path / "t"), queries.token_file(), block=1000, bits=bits)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, expected, stream = 0, [], []
    for r in order:
        ids = [*encoder.tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]
        expected.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
        stream += ids
    got = sorted((tuple(r) for r in bitplane.read_digests(spark, str(tmp_path / "t")).collect()), key=lambda r: r[1])
    assert got == expected
    blocks = sorted(bitplane.read_ids(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert [i for b in blocks for i in b.ids] == stream
    assert spark.read.parquet(str(tmp_path / "t" / "index")).count() == len(blocks)


def test_no_rows(spark, tmp_path):
    bitplane.write_tokens(spark.createDataFrame([], DOCS), str(tmp_path / "t"), queries.token_file())
    assert bitplane.read_digests(spark, str(tmp_path / "t")).collect() == []
