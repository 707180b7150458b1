"""The operators do the whole job: whole texts, whole vocabularies, all licences."""

import random

import public_tokenizers
from tokenizers import Tokenizer, models

from corpusloom.llm import license_scan, license_texts, quality_rules, queries, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
VOCAB = token_counts.sentencepiece_vocabulary(PATH)


def library(vocab):
    """A unigram library on the same list, with the byte pieces where the file has them."""
    bytes_at = {f"<0x{b:02X}>": i for b, i in zip(range(256), range(3, 259), strict=True)}
    names = {i: p for p, i in bytes_at.items()}
    return Tokenizer(models.Unigram([(p or names.get(i, f"\0{i}"), s) for i, (p, s) in enumerate(vocab)], unk_id=0, byte_fallback=True))


def texts():
    r = random.Random(8)
    words = ["the", "law", "été", "a", "Article", "12", "☃", "日本", "𝔘", "\r", "\xa0", "x▁y", "", "", "of"]
    out = ["", " ", "a\nb", "a  b", " \t\n", "\n\n\n", "a\t\tb ", "  a", "▁a", "\r\n"]
    return out + ["".join(r.choice(words) + r.choice([" ", " ", "  ", "\n", "\t", "\n\n", "     ", ""]) for _ in range(r.randint(1, 80))) for _ in range(150)]


def test_whole_texts_against_the_library(spark, tmp_path):
    want = library(VOCAB)
    every = texts()
    rows = spark.createDataFrame([*enumerate(every), (len(every), None)], "doc_id long, text string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in queries.op2_token_counts(spark, str(tmp_path)).collect()}
    assert got.pop(len(every)) == 0
    assert got == {i: len(want.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids) if t else 0 for i, t in enumerate(every)}
    assert got[2] == 3 and got[3] == 3


def test_float_scores_against_the_library():
    r = random.Random(9)
    vocab = [(p, s if i < 259 else s / 1000 - r.random()) for i, (p, s) in enumerate(VOCAB)]
    want, counter = library(vocab), token_counts.UnigramCounter(vocab)
    for t in texts()[1:]:
        t = token_counts.marked(t)
        assert counter.count_text(t)[0] == len(want.encode(t, add_special_tokens=False).ids), t


def test_licences_by_name_and_in_full(spark):
    full = {n: t for n, t, _ in license_texts.every({}) if n.endswith("-text") or n in license_texts.SHORT_TEXTS}
    lines = {
        "Released under the BSD License.": "bsd-notice", "Licensed under CC BY 4.0": "cc-by-4.0-notice", "Licensed under CC BY-SA 4.0.": "cc-by-sa-4.0-notice", "Licensed under CC BY-NC-SA 4.0.": "cc-by-nc-sa-4.0-notice",
        "This work is licensed under the GNU General Public License, version 2.": "gpl-2.0-notice", "licensed under the GNU Lesser General Public License, version 3": "lgpl-3.0-notice", "Distributed under the Mozilla Public License, v. 2.0": "mpl-2.0-notice",
        "SPDX-License-Identifier: AGPL-3.0": "agpl-3.0-notice", "Released under the Foo License.": None, "Licensed under the Apache License, Version 3.0.": None,
    }
    texts = [f"x {t} y" for t in (*full.values(), *lines)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {i: set() for i in range(len(texts))}
    for r in license_scan.scan_licenses(rows).collect():
        got[r.doc_id].add(r.license)
    for i, name in enumerate(full):
        assert name in got[i] and not [x for x in got[i] if x in full and x != name and not (x in ("gpl-2.0", "lgpl-2.1", "mpl-2.0") and name.startswith(("GPL", "LGPL", "MPL")))], (name, got[i])
    for i, (line, name) in enumerate(lines.items(), len(full)):
        assert got[i] == ({name} if name else set()), line


def test_the_longest_repeat_has_one_limit():
    def kept(n, k):
        words = [f"w{i}" for i in range(n - k)]
        return quality_rules.judge([" ".join(words + words[:k])], quality_rules.Limits())["kept"].tolist()

    assert kept(20_000, 64) == [True] and kept(20_000, 65) == [False] and kept(20_000, 2_000) == [False] and kept(700, 65) == [False]
