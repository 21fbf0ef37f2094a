"""Operators on single rows: media, licences, PII, shards."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from motifloom.llm import licenses, media, pii, sharding


# --- media ---


@given(st.integers(1, 9), st.integers(1, 9), st.integers(0, 2**31))
@settings(max_examples=40, deadline=None)
def test_formats_round_trip(height, width, seed):
    rng = np.random.default_rng(seed)
    colour = rng.integers(0, 256, (height, width, 3), dtype=np.uint8)
    assert (media.decode_image(media.encode_netpbm(colour)) == colour).all()
    assert (media.decode_image(media.encode_bmp(colour)) == colour).all()
    assert (media.decode_image(media.encode_netpbm(colour[:, :, 0])) == colour[:, :, 0]).all()


def test_other_netpbm():
    assert media.decode_image(b"P1\n# two\n2 2\n1 0\n0 1\n").tolist() == [[0, 255], [255, 0]]
    assert media.decode_image(b"P4 9 1\n\x80\x80").tolist() == [[0, *[255] * 7, 0]]
    assert media.decode_image(b"P2\n2 1\n15\n15 0\n").tolist() == [[255, 0]]
    assert media.decode_image(b"P5 1 1 65535\n\xff\xff").tolist() == [[255]]
    assert media.decode_image(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    for bad in (b"", b"P5 3 3 255\n12", b"P6 0 1 255\n", b"GIF89a", b"BM123", b"P6", b"P1\n2 2\n+ + + +", b"P1 1 1 7", b"P2\n1 1\n255\n" + b"9" * 25, b"P2 1 1 255 300", b"P6 1 1 9 \xff\xff\xff", media.encode_bmp(np.zeros((1, 1, 3), np.uint8))[:22] + b"\0\0\0\x80" + bytes(40)):
        with pytest.raises(ValueError):
            media.decode_image(bad)


@given(st.integers(1, 12), st.integers(1, 12), st.integers(1, 15), st.integers(1, 15))
@settings(max_examples=40, deadline=None)
def test_area_resize_by_brute_force(h, w, h2, w2):
    image = np.random.default_rng(h * 17 + w).integers(0, 256, (h, w)).astype(float)

    def cover(n, m):
        """Share of each of m cells that each of n pixels fills."""
        out = np.zeros((m, n))
        for i in range(m):
            for j in range(n):
                out[i, j] = max(0.0, min((i + 1) * n / m, j + 1) - max(i * n / m, j)) * m / n
        return out

    assert np.allclose(media.area_resize(image, h2, w2), cover(h, h2) @ image @ cover(w, w2).T)


def test_difference_hash_and_tiles():
    rising = np.tile(np.arange(64, dtype=np.uint8), (10, 1))
    assert media.difference_hash(rising) == "f" * 16
    assert media.difference_hash(rising[:, ::-1]) == "0" * 16
    tiles = media.thumbnail_tiles(np.zeros((200, 64, 3), np.uint8))
    shapes = [np.load(__import__("io").BytesIO(t)).shape for t in tiles]
    assert shapes == [(32, 32, 3)] * 3 + [(4, 32, 3)]


def test_media_query(odd_docs, no_docs, tmp_path):
    stored = media.media_from_texts(odd_docs, ["doc_id", "text", "key"])
    rows = media.media_features(stored, "media", ["doc_id", "text", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media", "media_bytes", "media_sha256"]).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        raw = (r["text"] or "").encode()
        payload = raw + b" " * (-len(raw) % 192) if raw else b" " * 192
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-16:])
        assert media.decode_image(bytes(r["media"])).tobytes() == payload
        assert (r["media_bytes"], r["media_sha256"]) == (len(r["media"]), hashlib.sha256(r["media"]).hexdigest())
        assert re.fullmatch("[0-9a-f]{16}", r["feature"])
    assert media.media_from_texts(no_docs, ["doc_id"]).count() == 0
    spark = odd_docs.sparkSession
    broken = spark.createDataFrame([(1, None), (2, bytearray(b"junk"))], "id long, media binary")
    assert [(r["feature"], bool(r["media_error"])) for r in media.media_features(broken, "media", ["id"]).orderBy("id").collect()] == [(None, False), (None, True)]
    media.write_tiles(media.media_features(stored, "media", ["doc_id"]), str(tmp_path / "tiles"), ["doc_id"])
    tile = spark.read.parquet(str(tmp_path / "tiles")).first()
    assert np.load(__import__("io").BytesIO(bytes(tile["npy"]))).shape[2] == 3


# --- licences ---


def brute_licenses(text):
    """By licence the best of all windows of whole words, whatever their size: (-score, -shared, first, last)."""
    words = re.findall("[a-z0-9]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    grams = list(zip(words, words[1:], strict=False))
    found = {}
    for name, template in licenses.TEMPLATES:
        w = re.findall("[a-z0-9]+", template.lower())
        t = set(zip(w, w[1:], strict=False))
        near = [k for k, g in enumerate(grams) if g in t]
        for a in near:
            seen = set()
            for b in range(a, min(len(grams), a + 2 * len(t) + 2)):
                seen.add(grams[b])
                shared = len(seen & t)
                score = 2.0 * shared / (len(seen) + len(t))
                if score >= licenses.THRESHOLD:
                    found[name] = min(found.get(name, (0,)), (-score, -shared, a, b + 1))
    return found


LICENSED = (
    "It is Released under the MIT License. Have a good day, and see the LICENSE file for details.",
    "Copyright 2020 Acme Corp. All rights\nreserved. Licensed under the\nApache License, Version 2.0.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without any restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, and/or sell copies, subject to the following conditions",
    "Licensed under the license. Licensed under CC BY 4.0! licensed under cc by-nc 4.0",
    licenses.TEMPLATES[11][1] + " tail of " + licenses.TEMPLATES[9][1],
    "released under the", "mit", "under the terms of the " * 30,
)


def test_licenses_by_brute_force(spark, odd_docs, docs, no_docs):
    own = spark.createDataFrame(list(enumerate(LICENSED)), "doc_id long, text string")
    both = odd_docs.select("doc_id", "text").union(docs.select("doc_id", "text")).union(own)
    seen = set()
    for r in licenses.scan_licenses(both.withColumn("__text", both.text), ["doc_id", "__text"]).collect():
        text = r["__text"] or ""
        got = {m["license"]: (-m["score"], -m["shared"], m["first"], m["last"]) for m in r["matches"]}
        assert got == brute_licenses(text) and [m["license"] for m in r["matches"]] == sorted(got)
        raw = text.encode()
        for m in r["matches"]:
            assert len(re.findall(b"[A-Za-z0-9]+", raw[m["start"] : m["end"]])) == m["last"] - m["first"] + 1
        seen |= set(got)
    assert {"MIT", "Apache-2.0", "All-Rights-Reserved", "CC-BY-4.0", "CC-BY-NC-4.0", "BSD-2-Clause", "BSD-3-Clause"} <= seen
    assert licenses.scan_licenses(no_docs, ["doc_id"]).count() == 0


# --- PII ---

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in values) % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": lambda: True, "ip": lambda: all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in value.split(".")), "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]()


def brute_spans(text):
    return [(k, m.start(), m.end()) for k, p in KINDS.items() for m in re.finditer(p, text) if valid(k, m[0])]


def test_base_spans_by_brute_force(odd_docs, docs, no_docs):
    tricky = ["a@b.c_d@e.f.g", "x@y", "1.2.3", "0001.2.3.0255 256.1.1.1 1.2.3.4.5.6.7.8", "4111-1111-1111-1111 4111  1111", "+1 23", "+1 (234) 567.8901- ", "a@b..c", "@a.b", "é@b.c ü.x@b-c.d", "5555555555554444 5105-1051 0510 5100", "+12.34.56.78", "++49 30 123456", "😀 1.1.1.1 x@y.z"]
    spark = docs.sparkSession
    more = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(tricky)], "doc_id long, text string")
    both = odd_docs.select("doc_id", "text").union(docs.select("doc_id", "text")).union(more)
    rows = both.rdd.map(tuple).collect()
    want = sorted((str(i), sorted(brute_spans(t or ""))) for i, t in rows)
    found = pii.sanitise(both, rewrite=False).collect()
    got = sorted((str(r["doc_id"]), sorted((s["kind"], s["start"], s["end"]) for s in r["pii_spans"] if s["kind"] in KINDS)) for r in found)
    assert got == want
    assert sum(len(x) for _, x in want) > 20
    assert pii.sanitise(no_docs, rewrite=False).count() == 0 == pii.sanitise(no_docs).count()


@given(st.text(alphabet="a@.0129+-() 4_", max_size=40))
@settings(max_examples=25, deadline=None)
def test_spans_of_random_texts(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [(s["kind"], s["start"], s["end"]) for r in pii.find_spans(df).collect() for s in [dict(x.asDict(), kind=pii.KINDS[x["kind"]]) for x in r["found"]]]
    assert got == brute_spans(text)


def test_rewriting_and_disclosure(spark):
    secret = "pat@corp.example.com"
    rows = [(k, f"Contact {secret} zanzibar office {k} alpha{'x' * (k % 3)} please") for k in range(1, 7)]
    rows += [(k, f"the office of number {k} please contact the desk") for k in range(10, 60)]
    rows += [(99, f"Contact {secret} zanzibar office 1 alphax please"), (100, None), (101, "plain")]
    out = {r["doc_id"]: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1]["text"].startswith("Contact <EMAIL>  ") and "zanzibar" not in out[1]["text"] and secret not in out[1]["text"]
    assert {s["kind"] for s in out[1]["pii_spans"]} >= {"email", "remove"}
    assert "office" in out[1]["text"]
    assert out[100]["text"] is None and out[101]["text"] == "plain" and out[10]["text"] == rows[6][1]
    # Against the formula: n(t,e) N / (n(t) n(e)) in bits, as a share of the entity's.
    n, n_e, n_t = len(rows), 7, 7
    assert np.log2(n_e * n / (n_t * n_e)) / np.log2(n / n_e) >= pii.REMOVE
    # Copies of one passage are one surrounding, so they are no evidence.
    same = [(k, f"Contact {secret} zanzibar office") for k in range(20)] + [(k, "other words here") for k in range(20, 60)]
    kinds = {s["kind"] for r in pii.sanitise(spark.createDataFrame(same, "doc_id long, text string")).collect() for s in r["pii_spans"]}
    assert kinds == {"email"}


def test_disclosure_of_rare_entities_anywhere_in_a_document(spark):
    filler = "the usual words of every text stand here between the parts"
    rows = [(1, f"Ottokar writes from one@mail.example.com {filler} and {filler} says Ottokar, gladly."), (2, f"two@mail.example.com {filler} Wilhelmina"), (3, f"{filler} two@mail.example.com and Wilhelmina again")]
    rows += [(k, f"{filler} and number says gladly writes from again {k}") for k in range(10, 200)]
    out = {r["doc_id"]: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "Ottokar" not in out[1]["text"] and "Wilhelmina" not in out[2]["text"] + out[3]["text"]
    assert [rows[0][1][s["start"] : s["end"]] for s in out[1]["pii_spans"] if s["kind"] == "remove"] == ["Ottokar", "Ottokar"]
    assert filler in out[1]["text"] and out[2]["text"].startswith("<EMAIL> " + filler) and out[10]["text"] == rows[3][1]


def test_sanitise_keeps_columns(odd_docs):
    out = pii.sanitise(odd_docs)
    assert out.columns == [*odd_docs.columns, "pii_spans"] and out.count() == odd_docs.count()
    assert "<CARD>" in out.where("doc_id = 10").first()["text"]


def test_native(docs):
    plan = pii.sanitise(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- shards ---


def test_shards_by_brute_force(odd_docs, docs, no_docs):
    for df, shards in ((docs, 24), (odd_docs, 3), (odd_docs, 100)):
        rows = df.select("doc_id", "text").rdd.map(tuple).collect()
        items = sorted(((i is not None, i or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for i, t in rows))
        total, upto, want, slots = sum(x[3] for x in items), 0, [], {}
        for known, i, crc, size in items:
            shard = (2 * upto + size) * shards // (2 * total)
            slots[shard] = slots.get(shard, -1) + 1
            want.append((i if known else None, size, crc, shard, slots[shard]))
            upto += size
        got = [tuple(r) for r in sharding.shard_by_bytes(df, shards, partitions=5).select("doc_id", "size", "text_crc32", "shard", "slot").collect()]
        key = lambda x: tuple(-1 if v is None else v for v in x)
        assert sorted(got, key=key) == sorted(want, key=key)
    assert sharding.shard_by_bytes(no_docs).count() == 0


def test_shard_sizes_differ_by_one_document(docs):
    rows = sharding.shard_by_bytes(docs, 8).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in rows]
    assert max(sizes) - min(sizes) <= 2 * sharding.shard_by_bytes(docs, 8).agg({"size": "max"}).first()[0]


@pytest.mark.parametrize("name", ["op2_pii", "op3_shards", "op4_vectors", "op5_shingle_join", "op7_licenses"])
def test_against_sql(spark, data, name):
    from motifloom.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    sql = queries.oracle_sql()
    if name not in sql:
        pytest.skip("not in SQL")
    got, want = queries.queries()[name](spark, data).toPandas(), con.execute(sql[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df[columns].astype(str).replace("<NA>", "nan").to_numpy().tolist()))
    assert rows(got) == rows(want)
