import hashlib
import random
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.brute import WORD, near


def test_rows_stage_by_stage(docs, spark, tmp_path):
    """``run`` against plain definitions of its five stages."""
    r = random.Random(8)
    vocabulary = ["".join(r.choices("abcdefghij", k=5)) for _ in range(400)]
    texts = {i: " ".join(r.sample(vocabulary, r.randrange(30, 60))) for i in range(60)}
    for i in range(5):
        texts[100 + i] = texts[i]  # exact copies
        texts[200 + i] = texts[10 + i] + " tail"  # near copies
    texts |= {300: "too short", 301: None, 302: "", 303: "a b c d e " * 20, 304: " ".join(vocabulary[:40]) + " #$%&" * 20}
    source = {i: "ab"[i % 2] for i in texts}
    docs([(i, t, "en", source[i]) for i, t in texts.items()]).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    clean = {i: t for i, t in texts.items() if i < 300}
    single = {max(i for i in clean if clean[i] == t): t for t in clean.values()}
    component = near(single.items())
    alone = {i: single[i] for i in {c for _, c in component.values()}}
    assert len(clean) == 70 and len(single) == 65 and len(alone) == 60

    copies = Counter(x.doc_id for x in got)
    assert set(copies) <= set(alone)
    size = {i: len(WORD.findall(t)) for i, t in alone.items()}
    mass = {s: sum(n for i, n in size.items() if source[i] == s) for s in "ab"}
    for s, weight in (("a", 1), ("b", 2)):  # targets are below three times the mass
        target = sum(mass.values()) * weight / 3
        own = [i for i in alone if source[i] == s]
        rate = target / mass[s]
        assert all(int(rate) <= copies[i] <= int(rate) + 1 for i in own)
        assert abs(sum(copies[i] * size[i] for i in own) - target) <= max(size.values())

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for x in got:
        ids = library.encode(alone[x.doc_id], add_special_tokens=False).ids
        assert (x.lang, x.source, x.n_tokens, list(x.ids)) == ("en", source[x.doc_id], len(ids), ids)
        assert x.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
