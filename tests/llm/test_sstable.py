import random

import pytest
from cases import LONG, empty, odd

from arborspark.llm import sstable


def entries(shards):
    out = []
    for r in shards.orderBy("shard").collect():
        reader = sstable.ShardReader(bytes(r.data))
        found = list(reader.scan())
        assert (len(found), reader.blocks) == (r.n_entries, r.n_blocks) and [k for k, _ in found] == sorted(k for k, _ in found)
        assert (sstable.decode_key(found[0][0]), sstable.decode_key(found[-1][0])) == (r.first_id, r.last_id)
        out += [(sstable.decode_key(k), None if v[:1] == b"\0" else v[1:].decode()) for k, v in found]
    return out


def test_round_trip_of_odd_rows(spark):
    df = odd(spark)
    shards = sstable.build_shards(df, block_bytes=256, max_shard_bytes=2000)
    want = sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert entries(shards) == want
    assert sstable.build_shards(empty(spark)).collect() == []
    got = sorted(((r.doc_id, None if r.value is None else bytes(r.value).decode()) for r in sstable.lookup(shards, [6, None, 5, 2, 12345, -9]).collect()), key=repr)
    assert got == sorted(((d, t) for d, t in want if d in (6, None, 5, 2, -9)), key=repr)


def test_lookup_in_one_shard():
    rng = random.Random(1)
    ids = sorted(rng.sample(range(-(10**9), 10**9), 3000) + [7] * 40)
    writer = sstable.ShardWriter(block_bytes=300)
    for i, x in enumerate(ids):
        writer.add(sstable.encode_key(x), b"%d" % i)
    reader = sstable.ShardReader(writer.finish())
    for x in rng.sample(ids, 300) + [7]:
        assert reader.get(sstable.encode_key(x)) == [b"%d" % i for i, y in enumerate(ids) if y == x]
    absent = [x for x in (rng.randrange(-(10**9), 10**9) for _ in range(2000)) if x not in set(ids)]
    assert all(reader.get(sstable.encode_key(x)) == [] for x in absent[:200])
    assert sum(reader.may_have(sstable.encode_key(x)) for x in absent) / len(absent) < 0.03


def test_damage_is_noticed():
    writer = sstable.ShardWriter()
    writer.add(sstable.encode_key(1), b"value")
    data = bytearray(writer.finish())
    data[12] ^= 1
    with pytest.raises(ValueError):
        sstable.ShardReader(bytes(data)).get(sstable.encode_key(1))
    with pytest.raises(ValueError):
        sstable.ShardReader(b"short")


def test_query_holds_the_table(spark, sf_dir, tmp_path):
    from arborspark.llm.queries import op6_sstable

    shards = op6_sstable(spark, sf_dir)
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(entries(shards)) == sorted((r.doc_id, r.text) for r in rows)
    saved = sstable.save(shards, str(tmp_path)).collect()
    assert sum(r.size for r in saved) == sum(p.stat().st_size for p in tmp_path.glob("*.sst")) > 0


def test_token_ids(spark):
    """Encoded documents as shards, looked up and decoded again."""
    from arborspark.llm import bpe

    df = odd(spark)
    encoded = bpe.encode(df)
    shards = sstable.build_shards(encoded, value_col="tokens")
    found = sstable.lookup(shards, [1, 2, 3, 5, -9]).collect()
    back = spark.createDataFrame([(r.doc_id, None if r.value is None else sstable.unpack_tokens(bytes(r.value))) for r in found], "doc_id bigint, tokens array<int>")
    texts = {r.doc_id: r.text for r in df.filter("doc_id in (1, 2, 3, 5, -9)").collect()}
    assert {r.doc_id: r.text for r in bpe.decode(back).collect()} == texts
    with pytest.raises(Exception, match="32 bits"):
        sstable.build_shards(spark.createDataFrame([(1, [-1])], "doc_id bigint, tokens array<int>"), value_col="tokens").collect()


def test_prefixes_are_compressed():
    writer, plain = sstable.ShardWriter(), sstable.ShardWriter(restart=1)
    for i in range(1000):
        for w in (writer, plain):
            w.add(sstable.encode_key(i), b"")
    assert len(writer.finish()) < 0.65 * len(plain.finish())
    assert sstable.decode_key(sstable.encode_key(-(2**63))) == -(2**63) and sstable.decode_key(b"") is None and LONG
