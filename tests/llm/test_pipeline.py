"""The pipeline's stages, each on its own input, against plain versions."""

import random
from collections import Counter

import corpus_pipeline as pipe

from tests.llm.test_joins_mix_topk import brute_components
from tests.llm.test_language_pages_licenses import WORDS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], SCHEMA)


def _corpus():
    rnd = random.Random(3)
    rows = []
    for i in range(40):
        lang = list(WORDS)[i % 3]
        rows.append((i, " ".join(rnd.choice(WORDS[lang]) + str(rnd.randint(0, 9)) for _ in range(30)), lang, f"s{i % 4}"))
    rows += [(100 + i, rows[i % 3][1], rows[i % 3][2], "s0") for i in range(8)] + [(5, rows[5][1], rows[5][2], "s1")] * 2
    return [*rows, (200, None, None, None), (201, "", "en", "s2"), (202, "#%&!" * 60, None, "s3")]


def test_language_stage_keeps_clean_documents(spark):
    rows = _corpus()
    kept = [r.doc_id for r in pipe.language_id(spark, _docs(spark, rows), "").collect()]
    assert Counter(kept) == Counter(r[0] for r in rows if r[0] != 202)


def test_one_document_of_each_group_stays(spark):
    rows = [r for r in _corpus() if r[0] != 5 or r[3] != "s1"]
    groups = brute_components([(i, t) for i, t, _, _ in rows])
    out = pipe.near_duplicates(spark, _docs(spark, rows), "")
    assert out.columns == pipe.COLUMNS
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, (n, c) in groups.items() if c == i or n == 0)
    repeated = [(1, "a b c d e f", "en", "s")] * 4 + [(1, "something else in here now", "en", "s")]
    assert sorted(r.text for r in pipe.near_duplicates(spark, _docs(spark, repeated), "").collect()) == ["a b c d e f", "something else in here now"]


def test_mixture_cuts_at_the_word(spark):
    rows = [r for r in _corpus() if r[0] < 100 and r[3] != "s1"]
    out = pipe.mixture(spark, _docs(spark, rows), "").collect()
    words = {r[0]: len((r[1] or "").split()) for r in rows}
    texts = {r[0]: r[1] for r in rows}
    by_source, sizes = Counter(), Counter()
    for r in rows:
        sizes[r[3]] += words[r[0]]
    for r in out:
        assert texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
        by_source[r.source] += len(r.text.split())
    assert abs(sum(by_source.values()) - 1.5 * sum(sizes.values())) <= len(sizes)
    assert all(by_source[s] <= 2 * sizes[s] for s in sizes)


def _plain_encoding(text, key, dropout=0.1):
    """The agenda on a whole text, one merge at a time: the best candidate, then the leftmost, unless its hash skips it for good."""
    import sentencepiece
    from lattice.llm.queries import tokenizer_path

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    mask = 2**64 - 1

    def skipped(a, b, c):
        h = (key + a * 0x9E3779B97F4A7C15 + b * 0xBF58476D1CE4E5B9 + c * 0x94D049BB133111EB) & mask
        h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & mask
        h = (h ^ (h >> 27)) * 0x94D049BB133111EB & mask
        return (h >> 11) / 2**53 < dropout

    def piece(t):
        i = sp.piece_to_id(t)
        return None if sp.is_unknown(i) or sp.is_byte(i) or sp.is_control(i) or sp.is_unused(i) else i

    symbols = [(i, i + 1, c) for i, c in enumerate(" " + text)] if text else []
    shown = [c if c == " " or c != "▁" and piece(c) is not None else None for _, _, c in symbols]  # None: spelled in bytes
    symbols = [(a, b, "▁" if s == " " else s, c) for (a, b, c), s in zip(symbols, shown, strict=True)]
    while True:
        found = []
        for i, (x, y) in enumerate(zip(symbols, symbols[1:], strict=False)):
            if x[2] and y[2] and (p := piece(x[2] + y[2])) is not None and not skipped(x[0], y[0], y[1]):
                found.append((-sp.get_score(p), i))
        if not found:
            break
        i = min(found)[1]
        symbols[i : i + 2] = [(symbols[i][0], symbols[i + 1][1], symbols[i][2] + symbols[i + 1][2], "")]
    return [j for _, _, s, c in symbols for j in ([piece(s)] if s else [sp.piece_to_id(f"<0x{b:02X}>") for b in c.encode()])]


def test_tokens_against_a_plain_agenda(spark):
    from pyspark.sql import functions as F

    rows = [(i, t, lang, s) for i, t, lang, s in _corpus() if i != 5][:12] + [(300, "Übergrößen ▁ und 漢字\n\n  twice  spaced, naïve words 😀", "de", "s"), (301, None, None, None), (302, "", "en", "s"), (303, "a", "en", "s"), (303, "a", "en", "s")]
    docs = _docs(spark, rows)
    keys = {(r.doc_id, r.text): r.k for r in docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.lit(42), F.lit(0), "doc_id", F.coalesce("text", F.lit(""))).alias("k")).collect()}
    got = Counter((r.doc_id, tuple(r.ids), r.n_tokens) for r in pipe.tokens(spark, docs, "").collect())
    plain = [(i, _plain_encoding(t or "", keys[i, t or ""] & (2**64 - 1))) for i, t, _, _ in rows]
    assert got == Counter((i, tuple(ids), len(ids)) for i, ids in plain)


def test_empty_tables_pass(spark):
    docs = _docs(spark, [])
    for _, stage in pipe.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0


def test_run(spark, tmp_path):
    _docs(spark, _corpus()).write.parquet(f"{tmp_path}/documents.parquet")
    out = pipe.run(spark, str(tmp_path))
    assert out.count() > 0 and out.columns == ["doc_id", "ids", "n_tokens"]
