import hashlib
import inspect
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from tapeloom.llm import mixing, secrets, simhash

from .test_mixing import plain_targets
from .test_robust_quality import plain_kept
from .test_secrets import all_rules, plain_blanked, plain_spans
from .test_simhash import plain_components


def plain_mix(rows):
    """Copies of each row by the line of its source."""
    sizes, line = defaultdict(int), defaultdict(list)
    for i, (doc_id, text, _, source, _) in enumerate(rows):
        n = len(text.translate({o: 32 for o in range(9, 14)}).split(" ")) - text.translate(
            {o: 32 for o in range(9, 14)}
        ).split(" ").count("")
        signed = xxhash.xxh64_intdigest(text.encode(), 42)
        signed -= (1 << 64) if signed >> 63 else 0
        key = f"{mixing.SEED}|{doc_id}|{source}|{signed}"
        sizes[source] += n
        line[source].append((n, hashlib.md5(key.encode()).hexdigest(), i))
    copies = {}
    for source, target in plain_targets(dict(sizes)).items():
        rate = target / sizes[source] if sizes[source] else 0.0
        offset = int(hashlib.md5(f"{mixing.SEED}|{source}".encode()).hexdigest()[:8], 16) / 2**32
        for place, (_, _, i) in enumerate(sorted(line[source])):
            copies[i] = int(np.floor((place + 1) * rate + offset) - np.floor(place * rate + offset))
    return copies


def test_stages_equal_brute_force(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    data = docs
    # quality rules
    kept = plain_kept([r[:4] for r in rows])
    rows = [r for r in rows if kept[r[0]]]
    data = corpus_pipeline.quality_rules(spark, data, "").cache()
    assert sorted(map(tuple, data.collect())) == sorted(rows)
    # near-duplicates
    prints = {r[0]: simhash.fingerprint(r[1]) for r in rows}
    roots = plain_components(list(prints.values()))
    first = {}
    for doc_id in sorted(prints):
        first.setdefault(roots[prints[doc_id]], doc_id)
    rows = [r for r in rows if first[roots[prints[r[0]]]] == r[0]]
    data = corpus_pipeline.near_dedup(spark, data, "").cache()
    assert sorted(map(tuple, data.collect())) == sorted(rows)
    # secrets
    clean = []
    for r in rows:
        spans = plain_spans(r[1], all_rules())
        text = plain_blanked(r[1], spans)
        clean.append((r[0], text, r[2], r[3], len(text) if spans else r[4]))
    assert any(secrets.BLANK in r[1] for r in clean)
    data = corpus_pipeline.secret_scan(spark, data, "").cache()
    assert sorted(map(tuple, data.collect())) == sorted(clean)
    # mix
    copies = plain_mix(clean)
    rows = [r for i, r in enumerate(clean) for _ in range(copies[i])]
    data = corpus_pipeline.mix_sources(spark, data, "").cache()
    assert sorted(map(tuple, data.collect())) == sorted(rows)
    # encoding
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = sorted(tuple(r) for r in corpus_pipeline.bpe_encode(spark, data, "").collect())
    want = []
    for doc_id, text, lang, source, _ in rows:
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        packed = bytearray(np.array(ids, dtype="<u4").tobytes())
        want.append((doc_id, lang, source, len(ids), packed, hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == sorted(want)


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"]
    assert out.count() > 100


def test_every_stage_takes_the_same_arguments():
    assert [list(inspect.signature(f).parameters) for _, f in corpus_pipeline.STAGES] == [["spark", "docs", "sf_dir"]] * 5


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_odd_rows(spark, stage, odd, clashing):
    name, function = stage
    out = function(spark, clashing, "")
    if name != "bpe_encode":
        assert out.columns == clashing.columns
    known = Counter(str(r["doc_id"]) for r in odd.collect())
    assert set(str(r["doc_id"]) for r in out.collect()) <= set(known)
    empty = function(spark, odd.where("false"), "")
    assert empty.count() == 0


def test_planted_documents(spark):
    rng = random.Random(11)
    prose = lambda n: " ".join("".join(rng.choice("aeioustrn") for _ in range(rng.randint(2, 9))) for _ in range(n))
    clean = [prose(rng.randint(60, 300)) for _ in range(150)]
    copies = [clean[0], clean[1].upper(), clean[2].replace(" ", "  ")]
    bad = ["# " * 100, "buy " * 80, "short", " ".join(w + "***" for w in prose(100).split())]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([*clean, *copies, *bad])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    good = corpus_pipeline.quality_rules(spark, docs, "")
    ids = {r["doc_id"] for r in good.collect()}
    assert set(range(150)) <= ids and not ids & set(range(153, 157))
    one = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs.where("doc_id < 153"), "").collect()}
    assert one == set(range(150))
