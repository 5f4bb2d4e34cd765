"""Encoders, token files, archives and secrets against the public library or plain Python."""

import base64
import bz2
import gzip
import hashlib
import random
import re
import urllib.parse
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from surveyfx.llm import bpe, idfiles, secrets, warc, words
from surveyfx.llm.common import shared_folder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", "  \n\n a", "I'll don't 'S ''s !'s", "x<|endoftext|>y <|endoftext|", "éàü ß ΑΣ Σ İI ﬁ", "a" * 3000, "ab" * 4000, " " * 999, "日本語 テキスト",
    "1234567 ½ ² Ⅷ ٣", "tab\there\x1c\x85  end", "line\nline\r\n\n  two  spaces", "🤖🤖 emoji", "x́ é",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (0, "")], "doc_id long, text string").withColumn("ids", F.lit("clash"))


def test_byte_pairs_match_the_library(docs):
    library = Tokenizer.from_file(BYTE)
    for r in bpe.decode(bpe.encode(docs, BYTE), BYTE).collect():
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want
        assert r["decoded"] == library.decode(want, skip_special_tokens=False) == (r["text"] or "")


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_byte_pairs_of_any_text(text):
    want = Tokenizer.from_file(BYTE) if not hasattr(test_byte_pairs_of_any_text, "lib") else test_byte_pairs_of_any_text.lib
    test_byte_pairs_of_any_text.lib = want
    assert np.frombuffer(bpe.tables(BYTE).encode(text), np.int32).tolist() == want.encode(text, add_special_tokens=False).ids


def test_words_match_the_library(docs):
    library = Tokenizer.from_file(WORD)
    for r in words.encode(docs, WORD).collect():
        assert r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [False, True])
def test_id_files_round_trip(spark, bits):
    rng = np.random.default_rng(1)
    lists = {i: rng.integers(0, 2**31 - 1 if i % 2 else 50_000, int(rng.integers(0, 300))).tolist() for i in range(0, 120, 3)}
    rows = [(i, v) for i, v in lists.items()] + [(None, [7]), (500, None), (501, [])]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>").orderBy("doc_id")
    folder = shared_folder(spark, "test-ids")
    manifest = idfiles.write_ids(df, folder, end_id=2, bits=bits, block_ids=256, file_ids=1000)
    got = sorted(idfiles.read_ids(spark, folder).collect(), key=lambda r: r["start"])
    at = 0
    for r, (doc, ids) in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)), strict=True):
        assert (r["doc_id"], r["start"]) == (doc, at)
        assert np.frombuffer(r["ids"], "<u4").tolist() == [*(ids or []), 2]
        at += r["n_tokens"]
    assert manifest.agg(F.sum("n_ids")).first()[0] == at and manifest.count() > 3


def test_id_files_of_nothing(spark):
    folder = shared_folder(spark, "test-ids")
    idfiles.write_ids(spark.createDataFrame([], "doc_id long, ids array<int>"), folder)
    assert idfiles.read_ids(spark, folder).count() == 0
    with pytest.raises(ValueError):
        next(idfiles.read_file(b"half a file"))


def test_archives(spark):
    rows = [(1, "http://a/x y\r\n", "same"), (9, None, "same"), (5, "u", "same"), (2, "b", None), (3, "c", ""), (4, "d", "é" * 9000), (None, "n", "lone"), (None, "m", "lone"), (7, "r", "twice"), (7, "r", "twice")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(3)
    folder = shared_folder(spark, "test-warc")
    warc.write_warc(df, folder, file_bytes=300)
    got = warc.read_warc(spark, folder).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got if r["page_id"] not in (None, 7)}
    for page, _, html in rows:
        if page in by:
            data = (html or "").encode()
            assert by[page]["payload_bytes"] == len(data) and by[page]["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert [(by[p]["record_type"], by[p]["refers_to"]) for p in (1, 5, 9, 2, 3, 4)] == [("revisit", 9), ("revisit", 9), ("response", None), ("revisit", 3), ("response", None), ("response", None)]
    assert by[4]["payload"].decode() == "é" * 9000 and by[1]["payload"] is None
    for page in (None, 7):
        assert sorted(r["record_type"] for r in got if r["page_id"] == page) == ["response", "revisit"]
    again = shared_folder(spark, "test-warc")
    warc.write_warc(df.repartition(5), again, file_bytes=300)
    files = [{r["path"].rsplit("/", 1)[1]: bytes(r["content"]) for r in spark.read.format("binaryFile").load(f"{f}/files/*.warc.gz").collect()} for f in (folder, again)]
    assert files[0] == files[1] and len(files[0]) > 1
    assert warc.read_warc(spark, folder).count() == len(rows)
    empty = shared_folder(spark, "test-warc")
    warc.write_warc(df.limit(0), empty)
    assert warc.read_warc(spark, empty).count() == 0


def archive_files(spark, folder):
    return {r["path"].rsplit("/", 1)[1]: bytes(r["content"]) for r in spark.read.format("binaryFile").load(f"{folder}/files/*.warc.gz").collect()}


def test_archives_are_the_same_for_any_partitions(spark):
    texts = [f"page {n % 90} " * (n % 40) for n in range(400)]
    rows = [(None if n == 7 else 3 if n < 60 else n * n, f"u{n}", t) for n, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    made = []
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for n in (3, 5):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            folder = shared_folder(spark, "test-warc")
            warc.write_warc(df.repartition(n), folder, file_bytes=6000, shard_bytes=9000)
            made.append(archive_files(spark, folder))
            got = warc.read_warc(spark, folder).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert made[0] == made[1] and len({name[:12] for name in made[0]}) > 3 and len(made[0]) > len({name[:12] for name in made[0]})
    # of each payload the largest id is the response, wherever shards begin
    last = {}
    for page, _, t in rows:
        last[t] = max(last.get(t, -1), -1 if page is None else page)
    by = {r["url"]: r for r in got}
    assert len(got) == len(by) == len(rows)
    for page, url, t in rows:
        if page is not None and page != last[t]:
            assert (by[url]["record_type"], by[url]["refers_to"]) == ("revisit", last[t])
    assert sum(r["record_type"] == "response" for r in got) == len(last)


def test_only_the_manifest_counts(spark):
    df = spark.createDataFrame([(n, "u", f"text {n}") for n in range(50)], "page_id long, url string, html string")
    folder = shared_folder(spark, "test-warc")
    warc.write_warc(df, folder)
    files = archive_files(spark, folder)
    system, root = idfiles.store(f"{folder}/files")
    with system.open_output_stream(f"{root}/pages-000009-000000.warc.gz") as out:
        out.write(next(iter(files.values())))
    assert warc.read_warc(spark, folder).count() == 50
    with system.open_output_stream(f"{root}/{next(iter(files))}") as out:
        out.write(next(iter(files.values()))[:-9])
    with pytest.raises(Exception, match="the manifest says"):
        warc.read_warc(spark, folder).count()


SECRET = "token: abcdEFGH1234"


@pytest.mark.parametrize(
    ("hidden", "depth"),
    [
        (urllib.parse.quote(SECRET, safe=""), 1),
        (urllib.parse.quote(urllib.parse.quote("é " + SECRET)), 2),
        (base64.b64encode(SECRET.encode()).decode(), 1),
        (base64.urlsafe_b64encode(("é?>" + SECRET).encode()).decode(), 1),
        (base64.b64encode(gzip.compress(SECRET.encode())).decode(), 1),
        (base64.b64encode(zlib.compress(base64.b64encode(SECRET.encode()))).decode(), 2),
        ("".join(f"\\u{ord(c):04x}" for c in SECRET), 1),
        ("".join(f"&#x{ord(c):x};" for c in SECRET), 1),
        ("%ff" + "".join(f"%{b:02x}" for b in SECRET.encode()), 1),
        ("".join(f"\\x{b:02x}" for b in b"\xff" + SECRET.encode()), 1),
        ("token+%3D+%61bcdEFGH1234", 1),
        (base64.b64encode(SECRET.encode("utf-16-le")).decode(), 1),
        (base64.b64encode(SECRET.encode("utf-16-be")).decode(), 1),
        (base64.b64encode(gzip.compress(b"first") + gzip.compress(SECRET.encode())).decode(), 1),
        (base64.b64encode(bz2.compress(b"first") + bz2.compress(SECRET.encode())).decode(), 1),
        (base64.b64encode(gzip.compress(b"\x00\xff" + SECRET.encode())).decode(), 1),
        (base64.encodebytes(gzip.compress(random.Random(1).randbytes(150) + b" " + SECRET.encode())).decode().rstrip(), 1),
        (base64.encodebytes(b"a word or two, then some more of them " + SECRET.encode() + b" and " * 20).decode().rstrip(), 1),
    ],
)
def test_secrets_in_layers(hidden, depth):
    text = f"über {hidden} end"
    found, large = secrets.spans(text)
    assert large == 0 and [(k, d) for _, k, _, d in found if d] == [(0, depth)]
    start, _, end, _ = found[-1]
    assert 5 <= start < end <= 5 + len(hidden)


def test_members_count_towards_the_size_of_a_layer(monkeypatch):
    monkeypatch.setattr(secrets, "LAYER_BYTES", 1000)
    assert secrets.spans(base64.b64encode(gzip.compress(b"a" * 900) + gzip.compress(b"a" * 900)).decode()) == ([], 1)


def test_secrets_base_rules(spark):
    rows = ["token: secret: abcdefgh12", "PASSWD='abcdefgh' x", "ſecret=abcdefgh", "AKIA" + "A" * 11, "AKIA" + "A" * 12, "f" * 31, "f" * 32, "z" + "0a" * 20 + "z", "", "%", "%zz \\u12 &#; &#99999999;", "A" * 5000]
    kinds = [re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")]
    df = spark.createDataFrame([(t,) for t in [*rows, None]], "text string").withColumn("secrets", F.lit(1))
    for r in secrets.find(df).collect():
        want = []
        for k, (pattern, least) in enumerate(zip(kinds, (8, 16, 32))):
            want += [(m.start(), k, m.end()) for m in pattern.finditer(r["text"] or "") if len(m[2] if k == 0 else m[0]) >= least]
        assert [(s["start"], secrets.KINDS.index(s["kind"]), s["end"]) for s in r["secrets"]["spans"] if s["depth"] == 0] == sorted(want)


def test_layer_bombs_are_counted(monkeypatch):
    monkeypatch.setattr(secrets, "LAYER_BYTES", 1000)
    assert secrets.spans(base64.b64encode(gzip.compress(b"a" * 5000)).decode()) == ([], 1)


@pytest.mark.parametrize("inner", [base64.b64encode(SECRET.encode()).decode(), urllib.parse.quote(SECRET, safe="")])
def test_secrets_hidden_twice_at_several_places(inner):
    hidden = base64.b64encode(inner.encode()).decode()
    text = f"one {hidden} two {hidden} three {inner} four"
    found, large = secrets.spans(text)
    places = [m.start() for m in re.finditer(re.escape(hidden), text)]
    assert large == 0 and len(places) == 2
    for at in [*places, text.index(inner)]:
        assert any(k == 0 and at <= s < e <= at + len(hidden) for s, k, e, _ in found)


@pytest.mark.parametrize("head", ["com/cb/", "key_", "a-", "x/y_z-", "abc", "QUJDREVGR0hJSktMTU5P/"])
@pytest.mark.parametrize("body", [SECRET.encode(), ("é?>~~~" + SECRET).encode(), gzip.compress(SECRET.encode(), mtime=0), base64.b64encode(SECRET.encode())])
def test_base64_behind_other_letters(head, body):
    if head == "abc" and body[:2] == b"\x1f\x8b":
        return  # no sign where the compressed bytes begin
    hidden = base64.b64encode(body).decode()
    found, large = secrets.spans(f"at {head}{hidden} end")
    assert large == 0 and any(k == 0 and 3 + len(head) - 4 <= s < e <= 3 + len(head) + len(hidden) for s, k, e, _ in found)


def test_every_piece_of_a_run_is_decoded():
    one, two = (base64.b64encode(f"token: {v}EFGH1234".encode()).decode().rstrip("=") for v in ("abcd", "wxyz"))
    text = f"{one}/x/{two}"
    starts = [s for s, k, _, d in secrets.spans(text)[0] if k == 0 and d]
    assert any(s < len(one) for s in starts) and any(s >= len(one) + 3 for s in starts)
