"""The operators on Spark: brute-force versions, and the edge cases that their docstrings define."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.llm import audio, components, dropout, packing, pii, quality_knn, quality_rules, simhash, substrings, token_counts, warc
from lodestream.llm import queries as llm_queries
from lodestream.llm.queries import vocabulary
from lodestream.session import scratch_path, written

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, extra=""):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


EDGE = [None, "", " ", "word", "a b c", "same text here " * 30, "same text here " * 30, "x" * 50_000, "long " * 30_000, "\n\n\t", "é😀 ▁ \x00 <|endoftext|>"]


def planted(spark):
    """Edge texts, copies, near copies, shared passages."""
    import random

    rnd = random.Random(5)
    passage = [f"p{rnd.randrange(10**6)}" for _ in range(60)]
    texts = list(EDGE)
    base = [f"w{rnd.randrange(500)}" for _ in range(300)]
    for k in range(12):
        own = list(base)
        own[k] = "changed"
        texts.append(" ".join(own))
    texts += [" ".join(base)] * 5
    for _ in range(6):
        texts.append(" ".join([f"q{rnd.randrange(10**6)}" for _ in range(40)] + passage + [f"q{rnd.randrange(10**6)}" for _ in range(40)]))
    texts.append(" ".join(passage[:35]))
    texts.append(" ".join(passage[:34]))
    return docs_of(spark, texts), texts


def collected(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_every_query_runs_over_its_whole_table(spark):
    n = {"documents": spark.read.parquet(f"{SF}/documents.parquet").count(), "pages": spark.read.parquet(f"{SF}/pages.parquet").count()}
    found = llm_queries.queries()
    assert {int(m[1]) for k in found if (m := re.match(r"op(\d+)_", k))} == set(range(1, 11))
    for name, query in found.items():
        result = query(spark, SF)
        key = "page_id" if name.startswith("op4") else "doc_id"
        assert result.select(key).distinct().count() == n["pages" if name.startswith("op4") else "documents"], name


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for result in (
        pii.counted(docs),
        audio.features(audio.media_column(docs)),
        token_counts.token_counts(docs, vocabulary("piece_bpe_32k.model")),
        warc.round_trip(pages),
        substrings.summary(docs),
        substrings.removed(docs),
        quality_knn.score(docs, labels),
        simhash.near_duplicates(docs),
        simhash.representatives(docs),
        dropout.encoded(docs, vocabulary("piece_bpe_32k.model")),
        quality_rules.score(docs),
        quality_rules.kept(docs),
        packing.pack(docs, vocabulary("word_bpe_49k.json")),
        pii.redact(docs),
    ):
        assert result.count() == 0


def brute_pii(text):
    def luhn(x):
        total = 0
        for i, c in enumerate(reversed(x)):
            v = int(c) * (1 + i % 2)
            total += v - 9 * (v > 9)
        return total % 10 == 0

    def digits(m):
        return re.sub("[^0-9]", "", m)

    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text) if f(m[0])] for k, p, f in kinds]


def test_pii_against_plain_patterns(spark):
    import random

    rnd = random.Random(3)
    parts = ["a@b.c", "@", ".", "..", "%", "x", "1", "255", "256", "1.2.3.4", "4111 1111 1111 1111", "-", " ", "+1", "(555)", "0", "000", "é", "😀", "\n", "+", "12345678901234567890", "4111111111111111"]
    texts = [None, "", *["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 14))) for _ in range(700)], "a@b.c " * 300, "1.2.3.4" * 200, "9" * 60_000, "a" * 60_000, "a@b" + ".c" * 30_000, "1 " * 30_000]
    found = collected(pii.counted(docs_of(spark, texts)))
    for i, t in enumerate(texts):
        expected = brute_pii(t or "")
        row = found[i]
        assert [row["n_email"], row["n_ip"], row["n_card"], row["n_phone"]] == [len(x) for x in expected], t[:200]
        assert row["base_sha256"] == hashlib.sha256(",".join(sum(expected, [])).encode()).hexdigest(), t[:200]
        assert [s for s in row["spans"].split(",") if s and s.split(":")[0] in pii.BASE_KINDS] == sum(expected, [])


def test_pii_added_kinds_and_redaction(spark):
    texts = [
        "IBAN DE89 3704 0044 0532 0130 00 ok",
        "DE89370400440532013001 wrong sum",
        "my ssn 123-45-6789 is",
        "code 123-45-6789 alone",
        "mail me@x.org or +1 (706) 555-3138, me@x.org",
        None,
        "clean",
        "for example DE89370400440532013000",
        "example of an IBAN: DE89370400440532013000",
        "account no. 12345678 at the bank",
        "number 12345678 of the bank",
        "account for order 12345678",
        "ssn of a test 123-45-6789",
    ]
    docs = docs_of(spark, texts).withColumn("_spans", F.lit("own")).withColumn("spans", F.lit(1))
    found = pii.counted(docs).orderBy("doc_id").collect()
    spans = [r["spans"] for r in found]
    assert spans[:4] == ["iban:5:32", "", "ssn:7:18", ""]
    assert spans[7:] == ["", "iban:20:42", "account:12:20", "", "", ""]
    assert [r["scores"] for r in found] == ["95", "", "75", "", "60,60,60", "", "", "", "60", "65", "", "", ""]
    with pytest.raises(ValueError, match="spans"):
        pii.with_spans(docs)
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    assert [r["text"] for r in clean.orderBy("doc_id").collect()][:8] == [
        "IBAN [IBAN] ok",
        texts[1],
        "my ssn [SSN] is",
        texts[3],
        "mail [EMAIL] or [PHONE], [EMAIL]",
        None,
        "clean",
        texts[7],
    ]


def test_context_raises_and_lowers_the_score_of_every_kind(spark):
    samples = {"email": "a@b.org", "ip": "10.1.2.3", "card": "4111 1111 1111 1111", "phone": "+1 706 555 3138", "iban": "DE89370400440532013000", "ssn": "123-45-6789", "account": "123456789"}
    speaks_for = {"email": "write to", "ip": "host", "card": "visa", "phone": "call", "iban": "iban", "ssn": "social", "account": "account"}
    assert set(samples) == {k.name for k in pii.KINDS}
    for kind in pii.KINDS:
        against = "version" if kind.name == "ip" else "sample"
        far = "x" * (pii.NEAR + 1)
        texts = [f"{w} {samples[kind.name]}" for w in ("plain", speaks_for[kind.name], against, f"{speaks_for[kind.name]} {against}", f"{speaks_for[kind.name]} {against} {far}")]
        rows = pii.with_spans(docs_of(spark, texts)).orderBy("doc_id").collect()
        scores = [next((round(s["score"], 6) for s in r["spans"] if s["kind"] == kind.name), None) for r in rows]
        expected = [kind.base, kind.base + pii.LIFT, kind.base - pii.LIFT, kind.base, kind.base]
        assert scores == [round(x, 6) if not kind.added or x >= pii.THRESHOLD else None for x in expected], kind.name


def test_ibans_end_where_their_country_says(spark):
    def valid(code, length):
        account = ("7A" * 17)[: length - 4]
        number = int("".join(str(int(c, 36)) for c in account + code + "00"))
        return f"{code}{98 - number % 97:02d}{account}"

    ibans = ["DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", *[valid(c, n) for n, codes in pii.IBAN_CODES.items() for c in codes.split()]]
    after = ["", " Thank you", " BIC COBADEFF", " 2024-01-01", " 5", " A", ", EUR", " ok", " DE89370400440532013000"]
    texts = [f"to {iban}{x}" for iban in ibans for x in after]
    found = collected(pii.counted(docs_of(spark, texts)))
    for i, t in enumerate(texts):
        stop = 3 + len(ibans[i // len(after)])
        second = [f"iban:{stop + 1}:{len(t)}"] if i % len(after) == len(after) - 1 else []
        assert [x for x in found[i]["spans"].split(",") if x.startswith("iban")] == [f"iban:3:{stop}", *second], t
    wrong = ["DE89370400440532013000x", "DE893704004405320130001", "xDE89370400440532013000", "DE88 3704 0044 0532 0130 00 Thank"]
    assert not any("iban" in r["spans"] for r in pii.counted(docs_of(spark, wrong)).collect())
    clean = pii.redact(docs_of(spark, ["DE89370400440532013000 Thank you"])).first()["text"]
    assert clean == "[IBAN] Thank you"


def brute_mulaw(code):
    code = ~code & 0xFF
    size = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
    return -size if code & 128 else size


def brute_alaw(code):
    code ^= 0x55
    low, segment = (code & 15) << 4, (code >> 4) & 7
    size = low + 8 if segment == 0 else (low + 264) << (segment - 1)
    return size if code & 128 else -size


def brute_adpcm(payload):
    """One block after the other, one nibble after the other."""
    out = []
    for at in range(0, len(payload), 192):
        block = payload[at : at + 192]
        value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
        out.append(value)
        for byte in block[4:]:
            for nibble in (byte & 15, byte >> 4):
                step = audio.STEP_SIZES[index]
                gap = (step >> 3) + (step >> 2) * (nibble & 1) + (step >> 1) * (nibble >> 1 & 1) + step * (nibble >> 2 & 1)
                value = max(-32768, min(32767, value - gap if nibble & 8 else value + gap))
                index = max(0, min(88, index + audio.INDEX_STEPS[nibble & 7]))
                out.append(value)
    return out


def brute_measures(samples):
    return f"{int((sum(x * x for x in samples) // len(samples)) ** 0.5)},{max(map(abs, samples))},{sum((a < 0) != (b < 0) for a, b in zip(samples, samples[1:], strict=False))}"


def test_media_round_trip(spark):
    docs, texts = planted(spark)
    docs = docs.withColumn("media", F.lit("own")).withColumn("pcm", F.lit("own")).withColumn("n_bytes", F.lit("own"))
    media = written(audio.media_column(docs), "media")
    found = collected(audio.features(media))
    stored = collected(media)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        row = found[i]
        assert (row["n_bytes"], row["payload_bytes"], row["payload_sha256"], row["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        if len(payload) > 20_000:
            continue
        linear = [brute_mulaw(c) for c in payload]
        pcm = [(a + b) >> 1 for a, b in zip(linear[::2], linear[1::2], strict=True)]
        samples, rate = audio.samples_of(bytes(stored[i]["pcm"]))
        assert rate == 4_000 and samples.tolist() == pcm
        parts = {"pcm": pcm, "mulaw": linear, "alaw": [brute_alaw(c) for c in payload], "adpcm": brute_adpcm(payload)}
        assert row["feature"] == ";".join(f"{k}={brute_measures(v)}" for k, v in parts.items()) + f";crc={zlib.crc32(bytes(stored[i]['pcm'])):08x}"
    assert found[5]["feature"] == found[6]["feature"] and found[5]["media_sha256"] == found[6]["media_sha256"]
    pcm = audio.resampled(media).filter("doc_id = 3").first()["media"]
    samples, rate = audio.samples_of(pcm)
    assert rate == 16_000 and len(samples) == 384


def test_token_counts_and_dropout(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    docs, texts = planted(spark)
    found = collected(token_counts.token_counts(docs, vocabulary("piece_bpe_32k.model"), budgets=(10,), with_table=True))
    pieces = dropout.encoded(docs, vocabulary("piece_bpe_32k.model"), check=True)
    assert pieces.filter("not lossless").count() == 0
    back = collected(dropout.decoded(pieces, vocabulary("piece_bpe_32k.model")))
    for i, t in enumerate(texts):
        t = t or ""
        assert found[i]["n_tokens"] == len(sp.encode(t)) and found[i]["n_bytes"] == len(t.encode())
        table = token_counts.counts_at(found[i]["prefix_tokens"])
        assert len(table) == len(t) + 1 and table[found[i]["fits"][10]] <= 10
        assert back[i]["text"] == t


def test_warc_round_trip(spark):
    big = "<p>" + "é😀" * 40_000
    tricky = "x" * 99 + "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"
    rows = [(1, "u", None), (2, "u", ""), (3, None, "short"), (4, "u", "short"), (5, "http://a/ü\r\nX: y", big), (7, "u", big), (6, "u", big), (8, "u", tricky), (9, "u", tricky), (9, "u", tricky), (10, "u", "y" * 100), (11, "u", "y" * 99), (12, "u", "y" * 99)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("number", F.lit(1)).repartition(3)
    path = scratch_path(spark, "warc-test")
    warc.write(pages, path)
    found = warc.read(spark, path, with_payload=True).collect()
    assert len(found) == len(rows)
    first = {}
    for i, _, h in rows:
        first[h or ""] = min(first.get(h or "", 99), i)
    texts = {i: h or "" for i, _, h in rows}
    for r in found:
        t = texts[r["page_id"]]
        revisit = len(t.encode()) >= 100 and first[t] != r["page_id"]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(t.encode()), hashlib.sha256(t.encode()).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", first[t]) if revisit else ("response", None))
        assert r["payload"] is None if revisit else bytes(r["payload"]).decode() == t


def test_pages_without_an_id_are_archived(spark):
    long, shared = "z" * 40_000, "s" * 200
    rows = [(None, "u", "short"), (None, "u", long), (None, None, None), (1, "u", shared), (2, "u", shared), (None, "u", shared)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    path = scratch_path(spark, "warc-null")
    warc.write(pages, path)
    found = warc.read(spark, path, with_payload=True).collect()
    shown = {(r["page_id"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"]).decode()) for r in found}
    assert len(found) == len(rows)
    assert shown == {(None, "response", None, "short"), (None, "response", None, long), (None, "response", None, ""), (1, "response", None, shared), (2, "revisit", 1, None), (None, "response", None, shared)}


def test_every_reference_names_a_record(spark):
    big = "<p>" + "é" * 40_000
    rows = [(9, "u", "s" * 200), (4, "u", "s" * 200), (4, "v", "s" * 200), (6, "u", "s" * 200), (1, "u", big), (2, "u", big), (None, "u", big), (3, "u", "t")]
    path = scratch_path(spark, "warc-references")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), path)
    headers = [h for f in spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).collect() for h, _ in warc.parse(bytes(f["content"]))]
    by_id = {h["warc-record-id"]: h for h in headers}
    assert len(by_id) == len(headers)
    revisits = [h for h in headers if h["warc-type"] == "revisit"]
    assert sorted(h["warc-page-id"] for h in revisits) == ["2", "6", "9"]
    for h in revisits:
        response = by_id[h["warc-refers-to"]]
        assert response["warc-type"] == "response" and response["warc-payload-digest"] == h["warc-payload-digest"] and response["warc-page-id"] == h["warc-refers-to-page-id"]
    for h in headers:
        if h["warc-type"] == "continuation":
            assert by_id[h["warc-segment-origin-id"]]["warc-segment-number"] == "1"


def test_lost_segments_raise(spark):
    schema = "record_type string, page_id long, digest string, refers_to long, origin string, number int, total long, block binary"
    whole = [("response", 1, "d", None, "o", 1, None, b"ab"), ("continuation", 1, "d", None, "o", 2, 4, b"cd")]
    assert bytes(warc.reassembled(spark.createDataFrame(whole, schema)).first()["block"]) == b"abcd"
    for broken in (whole[:1], whole[1:], [*whole, whole[1]], [whole[0], whole[1][:6] + (5, b"cd")]):
        with pytest.raises(Exception, match="segments do not add up"):
            warc.reassembled(spark.createDataFrame(broken, schema)).collect()


def brute_substrings(texts, window=35):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def test_substrings(spark):
    docs, texts = planted(spark)
    found = collected(substrings.summary(docs))
    expected = brute_substrings(texts)
    for i, (n, gone, kept) in enumerate(expected):
        assert (found[i]["n_words"], found[i]["n_removed"], found[i]["kept_sha256"]) == (n, gone, hashlib.sha256(kept).hexdigest()), i
    clashing = docs.withColumn("_k1", F.lit(1)).withColumn("key", F.lit(2)).withColumn("hash", F.lit(3))
    cut = substrings.removed(clashing)
    assert cut.columns == clashing.columns
    after = collected(cut)
    for i, (_, gone, kept) in enumerate(expected):
        assert after[i]["text"] == (kept.decode() if gone else texts[i])
    small = brute_substrings(texts[:40], 4)
    found = collected(substrings.summary(docs.limit(40), window=4))
    assert [found[i]["n_removed"] for i in range(len(texts[:40]))] == [g for _, g, _ in small]


def brute_components(texts):
    prints = np.array([simhash.fingerprint((t or "").encode()) for t in texts], np.uint64)
    root = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(texts)):
            near = np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 3)
            least = min(root[j] for j in near)
            for j in near:
                if root[j] != least:
                    root[j], changed = least, True
    return prints, root


@pytest.mark.parametrize(("run", "leaf"), [(simhash.RUN, simhash.LEAF), (5, 2), (1, 1)])
def test_simhash(spark, run, leaf):
    docs, texts = planted(spark)
    prints, root = brute_components(texts)
    found = collected(simhash.near_duplicates(docs, run=run, leaf=leaf))
    assert [found[i]["component_id"] for i in range(len(texts))] == root
    assert [found[i]["fp"] & (2**64 - 1) for i in range(len(texts))] == prints.tolist()


def brute_links(values):
    near = np.bitwise_count(values[:, None] ^ values[None]) <= 3
    root = np.arange(len(values))
    while True:
        after = np.array([root[row].min() for row in near])
        if (after == root).all():
            return root
        root = after


def test_the_index_keeps_every_link_and_prunes(spark):
    rnd = np.random.default_rng(4)
    base = rnd.integers(0, 2**64, 3000, np.uint64)
    near = base[:300].copy()
    for _ in range(3):  # up to three bits differ, in either half or both
        near ^= np.uint64(1) << rnd.integers(0, 64, len(near), np.uint64)
    dense = np.uint64(0xABCDEF0123456789) ^ (np.uint64(1) << rnd.integers(0, 64, (900, 2), np.uint64)).sum(axis=1).astype(np.uint64)
    values = np.unique(np.concatenate([base, near, dense]))
    table = written(spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long"), "test")
    found = {r["u"]: r["root"] for r in components.roots(simhash.links(table, run=16, leaf=4)).collect()}
    root = brute_links(values)
    groups = {}
    for i, r in enumerate(root):
        groups.setdefault(r, []).append(int(values[i].view(np.int64)))
    assert found == {v: min(g) for g in groups.values() for v in g if v != min(g)}
    runs = simhash.indexed(table, run=16)
    n = {r["ord"]: r["count"] for r in runs.groupBy("ord").count().collect()}
    pairs = {r["ord"]: r["count"] for r in simhash.near_runs(runs).groupBy("ord").count().collect()}
    assert all(pairs[o] < n[o] * (n[o] + 1) / 2 / 5 for o in (0, 1))  # the upper nodes drop over four pairs in five
    ids = [r["id"] for r in runs.select("id").collect()]
    assert sorted(ids) == list(range(len(ids)))


def test_one_row_of_each_component_stays(spark):
    docs, texts = planted(spark)
    _, root = brute_components(texts)
    kept = simhash.representatives(docs.union(docs).withColumn("fp", F.lit("own")).withColumn("_k1", F.lit("own")).withColumn("_id", F.lit("own")).withColumn("stays", F.lit(1)))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root)) and kept.columns[-4:] == ["fp", "_k1", "_id", "stays"]
    long = [" ".join(f"{p}{i}" for i in range(80)) for p in "abcde"]
    # ids that different texts share, and rows without an id, are told apart by their texts
    rows = [(7, long[0]), (7, long[1]), (None, long[2]), (None, long[2]), (None, long[3]), (9, long[3]), (8, long[0]), (None, long[4]), (7, long[0])]
    for table in (rows, rows[::-1]):
        kept = simhash.representatives(spark.createDataFrame(table, "doc_id long, text string").repartition(3)).collect()
        assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == sorted([("7", long[0]), ("7", long[1]), ("None", long[2]), ("9", long[3]), ("None", long[4])])
    assert {r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows[2:4], "doc_id long, text string")).collect()} == {None}


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + k) for k in range(1, 300)]
    edges = spark.createDataFrame(chain + star + [(5, 5), (7, 6)], "u long, v long")
    found = {r["u"]: r["root"] for r in components.roots(edges).collect()}
    assert found == {**{i: 0 for i in range(1, 201)}, **{1000 + k: 1000 for k in range(1, 300)}}


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {j for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def test_quality_rules(spark):
    import random

    rnd = random.Random(1)
    docs, texts = planted(spark)
    texts += ["\n".join(rnd.choice(["a b", "c", "", " ", "a b c d e f", "#|"]) for _ in range(rnd.randint(1, 30))) for _ in range(150)]
    texts += ["a b c d e a b c d e", "a b c d e", "a a a a a a", "a b c d", "x y z w v u x y z w v"]
    docs = docs_of(spark, texts)
    found = collected(quality_rules.score(docs))
    for i, t in enumerate(texts):
        expected = brute_statistics(t or "")
        row = found[i]
        assert tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == expected, (i, t[:80])
        failed = expected[0] < 10 or 100 * expected[4] > 20 * expected[0]
        assert row["base_failed"] == failed and not (failed and row["kept"])
    clashing = docs.withColumn("_words", F.lit(1)).withColumn("n_words", F.lit(2))
    kept = quality_rules.kept(clashing)
    assert kept.columns == clashing.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in found.items() if r["kept"])


def brute_fit(patterns):
    """Expectation-maximisation as one reads it in a textbook, document by document."""
    votes = np.array([v for v, n in patterns for _ in range(n)])
    k = votes.shape[1]
    share, on_good, on_bad = quality_rules.START_SHARE, np.full(k, quality_rules.START_GOOD), np.full(k, quality_rules.START_BAD)
    held = quality_rules.STRENGTH
    for _ in range(quality_rules.ROUNDS):
        like_good = share * np.where(votes == 1, on_good, np.where(votes == -1, 1 - on_good, 1)).prod(axis=1)
        like_bad = (1 - share) * np.where(votes == -1, on_bad, np.where(votes == 1, 1 - on_bad, 1)).prod(axis=1)
        p = like_good / (like_good + like_bad)
        share = (p.sum() + held * quality_rules.START_SHARE) / (len(p) + held)
        on_good = (p @ (votes == 1) + held * quality_rules.START_GOOD) / (p @ (votes != 0) + held)
        on_bad = ((1 - p) @ (votes == -1) + held * quality_rules.START_BAD) / ((1 - p) @ (votes != 0) + held)
    return share, on_good, on_bad


def votes_of(**cast):
    return tuple(cast.get(r.name, 1) for r in quality_rules.RULES)


def test_rules_part_good_from_bad_without_labels():
    clean, odd = votes_of(), votes_of(repetition=-1)
    symbols, shouting = votes_of(symbols=-1, symbol_share=-1), votes_of(capitals=-1, shouts=-1, punctuation=-1)
    echo = votes_of(repetition=-1, variety=-1, punctuation=-1, lines=0)
    patterns = [(clean, 800), (odd, 40), (symbols, 60), (shouting, 60), (echo, 60)]
    model = quality_rules.fit(patterns)
    share, on_good, on_bad = brute_fit(patterns)
    assert model.prior == pytest.approx(share) and model.on_good == pytest.approx(on_good) and model.on_bad == pytest.approx(on_bad)
    assert model.odds(clean) > 0 and max(model.odds(x) for x in (symbols, shouting, echo)) < 0
    # a lone bad vote of a rule that often accuses good documents is outvoted
    assert model.odds(odd) > 0
    assert quality_rules.fit([]).odds(clean) > 0


def test_the_verdict_is_not_all_must_pass(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    stats = written(quality_rules.statistics(docs), "test")
    model = quality_rules.fitted(stats)
    votes = F.array(*[r.vote() for r in quality_rules.RULES])
    rows = quality_rules.judged(stats, model).select("doc_id", "base_failed", "kept", "quality", votes.alias("votes")).collect()
    for r in rows:
        assert r["quality"] == pytest.approx(1 / (1 + np.exp(-model.odds(tuple(r["votes"])))))
        assert r["kept"] == (not r["base_failed"] and model.odds(tuple(r["votes"])) >= 0)
    accused = [r for r in rows if -1 in r["votes"] and not r["base_failed"]]
    assert any(r["kept"] for r in accused) and any(not r["kept"] for r in accused)
    known = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    good, bad = [r["kept"] for r in rows if known.get(r["doc_id"]) == 1], [r["kept"] for r in rows if known.get(r["doc_id"]) == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.05


def test_quality_rules_native(spark):
    import io
    from contextlib import redirect_stdout

    with redirect_stdout(text := io.StringIO()):
        quality_rules.score(docs_of(spark, EDGE)).explain()
        pii.counted(docs_of(spark, EDGE)).explain()
    assert not re.search("Python|Pandas|Arrow", text.getvalue())


def test_knn_accuracy_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = quality_knn.score(docs, labels)
    joined = scored.join(labels, "doc_id").filter("held_out").select("predicted", "quality").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in joined]) > 0.93
    edge = quality_knn.score(docs_of(spark, EDGE), labels.union(labels)).collect()
    assert len(edge) == len(EDGE) and all(0 <= r["score"] <= 1 for r in edge)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in edge)
    none = quality_knn.score(docs_of(spark, EDGE), labels.limit(0)).select("score").distinct().collect()
    assert [r["score"] for r in none] == [0.5]


def test_votes_against_a_plain_nearest_neighbour_search(spark):
    """Sums in whole numbers, neighbours by a full sort: equal scores however the texts are blocked, ties included."""
    docs = [r["text"].encode() for r in spark.read.parquet(f"{SF}/documents.parquet").filter("text is not null").orderBy("doc_id").collect()]
    texts = [*docs, b"", *docs[:20], *[t.encode() for t in EDGE if t]]
    terms = quality_knn.TermCounter()
    learned = [*docs[:60], *docs[:30]]  # copies tie
    labels = np.array([float(i % 3 == 0) for i in range(len(learned))])
    model = quality_knn.fit([terms.terms(t) for t in learned], labels, dimensions=16)
    projection = model.projection.astype(int).tolist()

    def unit(text):
        at, weights = terms.terms(text)
        sums = [sum(int(w) * projection[a][d] for a, w in zip(at, weights, strict=True)) for d in range(16)]
        size = sum(x * x for x in sums) ** 0.5
        return [round(x / size * quality_knn.UNIT_STEPS) for x in sums]

    sample = [unit(t) for t in learned]
    assert np.abs(np.array(sample) - model.vectors).max() <= 1
    expected = []
    for text in texts[:120]:
        own = model.latent([text])[0].astype(int).tolist()
        products = [sum(x * y for x, y in zip(own, v, strict=True)) for v in model.vectors.astype(int).tolist()]
        nearest = sorted(sorted(range(len(products)), key=lambda i: (-products[i], i))[: quality_knn.NEIGHBOURS])
        likeness = [max(products[i] / quality_knn.UNIT_STEPS**2, 0.0) ** quality_knn.SHARPNESS + 1e-9 for i in nearest]
        expected.append(sum(w * labels[i] for w, i in zip(likeness, nearest, strict=True)) / sum(likeness))
    assert model.scores(texts)[:120].tolist() == pytest.approx(expected, abs=1e-12)
    alone = [model.scores([t])[0] for t in texts]
    for block in (1, 7, 256, 1000):
        assert model.scores(texts, block=block).tolist() == alone
    assert model.scores(texts[::-1], block=5).tolist() == alone[::-1]


def test_knn_reads_no_column_but_the_text(spark):
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(40)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    texts = [f"good plain words number {i}" if i % 2 else f"BAD!! JUNK!! {i}!!" for i in range(60)]
    docs = docs_of(spark, texts)
    first = collected(quality_knn.score(docs, labels))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("score", F.lit(9)).withColumn("label", F.lit(1)).withColumn("at", F.lit(1)).repartition(5)
    assert collected(quality_knn.score(other, labels)) == first
    assert all(r["predicted"] == int(r["score"] >= 0.7) == i % 2 for i, r in first.items())
    lost = quality_knn.score(docs.withColumn("doc_id", F.lit(None).cast("long")), labels).collect()
    assert len(lost) == 60 and all(r["held_out"] is None for r in lost)


@pytest.mark.parametrize("length", [16, 2048])
def test_packing(spark, length):
    from tokenizers import Tokenizer

    docs, texts = planted(spark)
    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    pieces = packing.pack(docs.repartition(4), vocabulary("word_bpe_49k.json"), length=length)
    rows = pieces.collect()
    whole, stream = {}, {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        own = whole.setdefault(r["doc_id"], [])
        assert r["start"] == len(own) and len(ids) == r["length"] > 0
        own += ids
        stream.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        assert whole[i] == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        assert {r["doc_tokens"] for r in rows if r["doc_id"] == i} == {len(whole[i])}
    assert sorted(stream) == list(range(len(stream)))
    for k, parts in stream.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == length or k == len(stream) - 1
    made = packing.sequences(pieces, length).collect()
    assert all(len(r["ids"]) == 4 * length for r in made) and sum(r["n_tokens"] for r in made) == sum(map(len, whole.values()))
    assert sum(len(r["boundaries"]) for r in made) == len(texts)
    crc = packing.with_crc(pieces).first()
    assert crc["ids_crc32"] >= 0


def test_rows_without_an_id_and_clashing_columns(spark):
    """Rows without an id have results like others; columns named like a result or a helper change nothing."""
    texts = [t for t in EDGE if t is None or len(t) < 1000] + ["write to a@b.org", "word " * 60]
    rows = [(i % 7 or None, t, "en", "s", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    names = "n_bytes n_tokens fits prefix_tokens ids lossless start length ids_crc32 doc_tokens sequence_id offset n_words n_removed kept_sha256 k1 k2 copies hash second runs kept quality base_failed fp component_id root spans scores media pcm score".split()
    clashing = docs.select("*", *[F.lit("own").alias(n) for n in names])
    pieces, words = vocabulary("piece_bpe_32k.model"), vocabulary("word_bpe_49k.json")
    operators = {
        "pii": lambda d: pii.counted(d),
        "media": lambda d: audio.features(audio.media_column(d)),
        "tokens": lambda d: token_counts.token_counts(d, pieces).select("doc_id", "n_bytes", "n_tokens"),
        "substrings": lambda d: substrings.summary(d),
        "simhash": lambda d: simhash.near_duplicates(d),
        "dropout": lambda d: dropout.encoded(d, pieces),
        "rules": lambda d: quality_rules.score(d),
        "packing": lambda d: packing.with_crc(packing.pack(d.coalesce(1), words)),
    }
    for name, operator in operators.items():
        plain, other = (sorted(map(repr, operator(d).collect())) for d in (docs, clashing))
        assert plain == other and sum("doc_id=None" in r for r in plain) >= 2, name
    for operator in (pii.redact, substrings.removed, simhash.representatives, quality_rules.kept):
        after = operator(clashing)
        assert after.columns == clashing.columns
        assert sorted(r["text"] or "" for r in after.collect()) == sorted(r["text"] or "" for r in operator(docs).collect())


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs, texts = planted(spark)
    docs = docs.union(spark.createDataFrame([(500, "write to me@example.org " + " ".join(f"clean{i}" for i in range(60)), "en", "s", 1)], SCHEMA))
    columns = docs.columns
    for k, (name, stage) in enumerate(pipeline.STAGES):
        after = stage(spark, docs, SF)
        if k < len(pipeline.STAGES) - 1:
            assert after.columns == columns, name
            rows = collected(after)
            if name == "quality_rules":
                verdicts = collected(quality_rules.score(docs))
                assert set(rows) == {i for i, r in verdicts.items() if r["kept"]} and 500 in rows
            if name == "simhash_near_dedup":
                before = sorted(docs.collect(), key=lambda r: r["doc_id"])
                _, root = brute_components([r["text"] for r in before])
                assert set(rows) == {before[i]["doc_id"] for i in set(root)} and after.count() == len(rows)
            if name == "substring_dedup":
                before = sorted(docs.collect(), key=lambda r: r["doc_id"])
                for r, (_, gone, kept) in zip(before, brute_substrings([r["text"] for r in before]), strict=True):
                    assert rows[r["doc_id"]]["text"] == (kept.decode() if gone else r["text"])
            if name == "pii":
                assert rows[500]["text"].startswith("write to [EMAIL] clean0")
            assert all(r["n_chars"] == len(r["text"]) for r in rows.values()) or k < 2
        docs = written(after, "test")
    assert docs.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert pipeline.run(spark, SF).count() > 0
