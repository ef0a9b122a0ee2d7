"""Quality figures and fitted bands against plain loops over the texts."""

import re
from collections import Counter
from math import log2

import numpy as np

from tidemill.llm import quality_rules

WORDS = [c + v + d for c in "bdfgklmnprst" for v in "aeiou" for d in "lmnrst"]


def prose(seed, n, mark=""):
    rng = np.random.default_rng(seed)
    return " ".join(str(rng.choice(WORDS)) + mark for i in range(n))


def plain(text):
    """The base columns, by the words of the contract."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_against_plain_loops(spark):
    import sentencepiece
    from public_tokenizers import path

    texts = [None, "", " \n\t\x0b ", "a b c a b c", "é ü # $ <>\nline\nline\n\nline ", "東京 タワー 東京", "x" * 50_000, "same three words " * 400, "日本" * 3000]
    texts += [prose(i, 60 + 3 * i) for i in range(60)] + [prose(90 + i, 90, " #*% $&|") for i in range(4)]
    rows = [(i, t, [None, "en", "de"][i % 3] if i < 9 else "en", "own") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _tm_row string").repartition(3)
    got = {r["doc_id"]: r for r in quality_rules.quality_features(docs).collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    figures = {}
    for i, t in enumerate(texts):
        r = got[i]
        base = plain(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base, i
        assert r["base_failed"] == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        tokens = [x for w in re.findall(r"[^\x20\x09-\x0D]+", t or "") for x in model.encode(w)]
        entropy = -sum(c / len(tokens) * log2(c / len(tokens)) for c in Counter(tokens).values())
        figures[i] = (base[1] / len(tokens) if tokens else 0, np.mean([model.is_byte(x) for x in tokens]) if tokens else 0, entropy, len(tokens))
        assert r["n_tokens"] == len(tokens) and np.allclose([r["chars_per_token"], r["byte_share"], r["token_entropy"]], figures[i][:3])
    for i, r in got.items():
        if r["base_failed"]:
            assert not r["kept"]
            continue
        length = lambda n: sum(n >= x for x in quality_rules.LENGTHS)
        peers = [figures[k] for k in got if not got[k]["base_failed"] and got[k]["script"] == r["script"] and length(figures[k][3]) == length(figures[i][3])]
        bad = set()
        if len(peers) >= quality_rules.LEAST_ROWS:
            for k, (name, least) in enumerate(quality_rules.LEAST_SPREAD.items()):
                low, mid, high = np.percentile([round(p[k], 3) for p in peers], [25, 50, 75])
                reach = quality_rules.REACH * max((high - low) / 1.349, least)
                if (figures[i][k] < mid - reach and name != "byte_share") or (figures[i][k] > mid + reach and name != "token_entropy"):
                    bad.add(name)
                if min(abs(figures[i][k] - mid - reach), abs(figures[i][k] - mid + reach)) < 2e-3:  # halves are not rounded alike
                    bad ^= {name} & (bad ^ set(r["failed"].split(",")))
        else:
            band = quality_rules.BANDS[r["script"]]
            low, high = band.chars_per_token
            fails = (not low <= figures[i][0] <= high, figures[i][1] > band.byte_share, figures[i][2] < band.entropy)
            bad = {name for name, fail in zip(quality_rules.LEAST_SPREAD, fails, strict=True) if fail}
        assert set(filter(None, r["failed"].split(","))) == bad and r["kept"] == (not bad), (i, figures[i], r)
    assert not any(got[i]["kept"] for i in range(69, 73)) and sum(got[i]["kept"] for i in range(9, 69)) >= 59
    kept = quality_rules.quality_filter(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}
    assert {r["_tm_row"] for r in kept.collect()} == {"own"}
    assert quality_rules.quality_filter(docs.where("false")).count() == 0
