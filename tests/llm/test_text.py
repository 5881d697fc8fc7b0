"""Decontamination, quality, tokens, licences, rollups, search and the pipeline against brute force or public libraries."""

import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.llm import bpe, decontaminate, license_scan, quality_crf, token_rollup, topk_search

from . import brute

CLASHING = "doc_id long, text string, rid long, norm string, row string, lang string, source string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y", "en", "s") for i, t in rows], CLASHING)


def test_decontaminate(spark):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "naïve", "the", "of"]
    some = lambda k: " ".join(rnd.choice(vocabulary) for _ in range(k))
    items = [(k, some(20)) for k in range(6)] + [(6, "short item, Only FIVE words"), (7, ""), (8, None), (None, some(15)), (9, "the the the"), (3, some(16))]
    rows = [(i, f"{some(10)} {(items[i % 7][1] or '').upper() if i % 3 else ''} -- {some(20)}") for i in range(30)] + [(100, None), (101, ""), (102, "the, the; THE the"), (None, items[0][1]), (103, some(4000))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.decontaminate(frame(spark, rows), bench).collect()}
    want = brute.contamination(rows, items)
    assert got == want and sum(w[1] > 0 for w in want.values()) > 10
    kept = decontaminate.keep_clean(frame(spark, rows), bench)
    assert kept.columns == ["doc_id", "text", "rid", "norm", "row", "lang", "source"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, w in want.items() if not w[4])
    assert decontaminate.decontaminate(frame(spark, []), bench).collect() == []
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.decontaminate(frame(spark, rows), none).collect()} == {0}


def test_decontaminate_runs_no_python(spark, monkeypatch):
    """With the broadcast bound at nothing the joins shuffle, and results are the same."""
    rows, items = [(i, "alpha beta gamma " * (i % 4) + "delta " * 13) for i in range(12)], [(1, "delta " * 13), (2, "alpha beta gamma")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", -1)
    df = decontaminate.decontaminate(frame(spark, rows), bench)
    assert "Python" not in df._jdf.queryExecution().toString() and "MapIn" not in df._jdf.queryExecution().toString()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()} == brute.contamination(rows, items)


GOOD = ["The river runs past the old mill and on to the sea.", "Nobody could say when the bridge had been built.", "They walked home in the rain, talking of nothing."]
BAD = ["BUY!! NOW!! CHEAP!! DEALS!!", "a$$$ b%%% c### d&&& e***", "x | y | z | x | y | z"]


def labelled(n=160, seed=0):
    rnd = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        bad = i % 4 == 0
        rows.append((i, "\n".join(rnd.choice(BAD if bad else GOOD) for _ in range(rnd.randint(1, 9)))))
        marks.append((i, int(not bad), 0))
    return rows, marks


def test_quality(spark):
    rows, marks = labelled()
    rows += [(1000, None), (1001, ""), (None, GOOD[0]), (1002, GOOD[0] * 20_000), (0, rows[0][1])]
    labels = spark.createDataFrame([*marks, (None, 1, 0), (2000, None, None)], "doc_id long, quality int, toxic int")
    got = quality_crf.quality_scores(frame(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    truth = {i: q for i, q, _ in marks}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 30 and all(r.predicted == truth[r.doc_id] for r in held)
    kept = quality_crf.keep_good(frame(spark, rows), labels)
    assert kept.columns == frame(spark, []).columns
    good = {i for i, q in truth.items() if q}
    assert good <= {r.doc_id for r in kept.collect()}


def test_quality_ranks_held_out_documents(spark):
    """On the driver's tables, where they are: held-out documents are ranked and told apart."""
    import os

    sf = "/root/testdata/sf0.01"
    if not os.path.exists(f"{sf}/labels.parquet"):
        pytest.skip("no driver tables")
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality IS NOT NULL").collect()}
    rows = [(r.score, truth[r.doc_id]) for r in quality_crf.op8_quality_crf(spark, sf).collect() if r.held_out and r.doc_id in truth]
    good, bad = [s for s, q in rows if q], [s for s, q in rows if not q]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert len(rows) > 50 and auc > 0.97
    assert sum((s >= 0.5) == bool(q) for s, q in rows) / len(rows) > 0.95


def test_a_fit_reads_a_bounded_number_of_lines(spark):
    rows, marks = labelled()
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    rows = [(i, (t or "") + "\nmore of it" * 200) for i, t in rows]
    for lines in (1, 50, 1000):
        model = quality_crf.train(frame(spark, rows), labels, lines=lines)
        assert model.constant is None or lines < 1000
    rows = [(i, t + "\nline" * 6000) for i, t in rows]  # documents of any length are learned from
    assert quality_crf.train(frame(spark, rows), labels).constant is None


def test_quality_without_labels(spark):
    rows, _ = labelled(8)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_crf.quality_scores(frame(spark, rows), none).collect()} == {0.5}
    one = spark.createDataFrame([(0, 1, 0), (2, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_crf.quality_scores(frame(spark, rows), one).collect()} == {1.0}
    assert quality_crf.quality_scores(frame(spark, []), one).collect() == []


def test_marginals_are_those_of_all_labelings():
    """Forward and backward passes against the sum over every labeling of a short chain."""
    import itertools
    import math

    import numpy as np

    score, move = np.array([0.3, -1.2, 0.8, 2.0]), np.array([[0.5, -0.4], [-0.7, 0.9]])
    weight = {}
    for y in itertools.product((0, 1), repeat=4):
        weight[y] = math.exp(sum(s * v for s, v in zip(score, y, strict=True)) + sum(move[a, b] for a, b in itertools.pairwise(y)))
    total = sum(weight.values())
    p, pairs = quality_crf.marginals(score, move, np.array([0, 4]))
    assert np.allclose(p, [sum(w for y, w in weight.items() if y[t]) / total for t in range(4)])
    assert np.allclose(pairs, [[sum(w * sum(y[t] == a and y[t + 1] == b for t in range(3)) for y, w in weight.items()) / total for b in (0, 1)] for a in (0, 1)])


def public_coder():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    return path, P.PATTERN, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def test_bpe(spark):
    import hashlib
    import struct

    path, pattern, coder = public_coder()
    rnd = random.Random(9)
    letters = "aabbcde  \n\t.=-'s0é漢😀ß́‍"
    texts = ["", None, "the " * 2000, " " * 400, "=" * 999, "<|endoftext|>", "it's we'll I'd", "\x00\x01", "naïve café 漢字 😀👩‍👩"]
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 80))) for _ in range(300)]
    got = {r.doc_id: r for r in bpe.bpe_digests(frame(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        ids = coder.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() and got[i].valid_utf8
    wide = bpe.bpe_encode(frame(spark, [(1, "hello world"), (1, "hello world"), (None, None)]))
    assert wide.columns == ["doc_id", "rid", "norm", "row", "lang", "source", "ids", "n_tokens", "decoded_sha256"]
    rows = wide.collect()
    assert [list(r.ids) for r in rows] == [coder.encode_ordinary("hello world")] * 2 + [[]]
    assert bpe.bpe_digests(frame(spark, [])).collect() == []
    assert bpe._coder(path, pattern)[1].coder.merges.ranks


def test_bpe_transducer_forgets_and_streams():
    path, pattern, coder = public_coder()
    small = bpe.Transducer(bpe.Merges(bpe.read_ranks(path)), moves=50)
    for word in ("internationalisation", " thndhain", "ööööé", "=====" * 30):
        assert small.encode(word.encode()) == coder.encode_ordinary(word)
    decoder = bpe._coder(path, pattern)[2]
    text = "漢字 and 😀 naïve" * 3
    ids = bpe.encode_text(text, path, pattern)
    assert "".join(decoder.stream([ids[i : i + 1] for i in range(len(ids))])) == text
    whole = list(decoder.stream([ids[i : i + 1] for i in range(len(ids))]))
    assert "�" not in "".join(whole) and decoder.state(ids) == 0
    half = bpe.encode_text("😀", path, pattern)[:1]
    assert decoder.state(half) not in (0, 8) and list(decoder.stream([half])) == ["", "�"]
    with pytest.raises(ValueError, match="no token"):
        decoder.bytes(ids * 0 + 10**6)


def test_licenses(spark):
    mit = 'MIT License\n\nCopyright (c) 2024 A\nPermission is hereby granted, free of charge, to any person obtaining a copy of it. The above copyright notice and this permission notice shall be included in all copies.\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS.'
    bsd = 'Redistribution and use in source and binary forms, with or without modification, are permitted. Redistributions of source code must retain the above copyright notice. Redistributions in binary form must reproduce the above copyright notice. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS".'
    rows = [(1, mit), (2, bsd), (3, "Released under the MIT License."), (4, None), (5, ""), (6, "Licensed under CC BY-NC 4.0."), (7, "No licence is named here."), (8, "Under the GNU General Public License, version 3 or, at your option, any later version.\nLicensed under the Apache License, Version 2.0."), (None, "word " * 100_000), (3, "Released under the MIT License.")]
    got = sorted((str(r.doc_id), r.licenses) for r in license_scan.license_scan(frame(spark, rows)).collect())
    assert got == sorted([("1", "MIT"), ("2", "BSD-2-Clause"), ("3", "MIT"), ("3", "MIT"), ("4", ""), ("5", ""), ("6", "CC-BY-NC"), ("7", ""), ("8", "Apache-2.0,GPL-3.0-or-later"), ("None", "")])
    assert license_scan.license_scan(frame(spark, [])).collect() == []


# Notices as they stand in files: wrapped, some in comments.
WRAPPED = {
    "GPL-3.0-or-later": """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
#
# You should have received a copy of the GNU General Public License
# along with this program.  If not, see <https://www.gnu.org/licenses/>.
""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify it
under the terms of the GNU General Public License as published by the
Free Software Foundation; either version 2 of the License, or (at your
option) any later version.
""",
    "LGPL-2.1-or-later": """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:

1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS
IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
""",
    "BSD-3-Clause": """Copyright (c) 2020, A. N. Author
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
    * Redistributions of source code must retain the above copyright
      notice, this list of conditions and the following disclaimer.
    * Redistributions in binary form must reproduce the above copyright
      notice, this list of conditions and the following disclaimer in the
      documentation and/or other materials provided with the distribution.
    * Neither the name of the copyright holder nor the
      names of its contributors may be used to endorse or promote products
      derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
""",
    "Apache-2.0": """// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at
//
//     http://www.apache.org/licenses/LICENSE-2.0
//
// Unless required by applicable law or agreed to in writing, software
// distributed under the License is distributed on an "AS IS" BASIS,
// WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED.
""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES.
""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE.
""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty.
In no event will the authors be held liable for any damages.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented.
2. Altered source versions must be plainly marked as such.
3. This notice may not be removed or altered from any source distribution.
""",
    "GPL-2.0-only": "/* SPDX-License-Identifier: GPL-2.0-only */\nint main(void) { return 0; }",
    "Apache-2.0,MIT": "Licensed under either of Apache License, Version 2.0\nor the MIT license, as you like.",
    "EPL-2.0": "This program and the accompanying materials are made available under the\nterms of the Eclipse Public License v2.0.",
    "AGPL-3.0": "Released under the GNU AGPL v3.",
    "LGPL": "Linked with a library under the GNU LGPL",
    "BSD-3-Clause,MIT": "Parts are released under the New BSD License.\nThe rest is licensed under the MIT license.",
    "": "The apache helicopter has a mit license plate. He got a license to teach under the bridge, with rubies.",
}


def test_wrapped_licenses(spark):
    rows = list(enumerate(WRAPPED.values()))
    got = {r.doc_id: set(r.licenses.split(",")) for r in license_scan.license_scan(frame(spark, rows)).collect()}
    assert got == {i: set(name.split(",")) for i, name in enumerate(WRAPPED)}


SYSTEM_LICENCES = "/usr/share/common-licenses"
WHOLE_FILES = {"GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "Artistic": "Artistic-1.0", "Apache-2.0": "Apache-2.0"}


@pytest.mark.skipif(not os.path.isdir(SYSTEM_LICENCES), reason="the system has no licence files")
def test_whole_licence_files(spark):
    texts = {name: open(f"{SYSTEM_LICENCES}/{name}", encoding="utf-8", errors="replace").read() for name in WHOLE_FILES if os.path.exists(f"{SYSTEM_LICENCES}/{name}")}
    names = list(texts)
    rows = [(i, texts[n]) for i, n in enumerate(names)]
    # two licences one after the other stay two; where the first lacks its end, what it mentions counts too
    pairs = [(a, b) for a, b in (("GPL-3", "GPL-2"), ("GPL-2", "Apache-2.0"), ("GFDL-1.2", "LGPL-3")) if a in texts and b in texts]
    rows += [(100 + i, texts[a] + "\n\n" + texts[b]) for i, (a, b) in enumerate(pairs)]
    rows += [(200 + i, texts[a][: len(texts[a]) // 2] + "\n\n" + texts[b]) for i, (a, b) in enumerate(pairs)]
    got = {r.doc_id: set(r.licenses.split(",")) for r in license_scan.license_scan(frame(spark, rows)).collect()}
    assert {n: got[i] for i, n in enumerate(names)} == {n: {WHOLE_FILES[n]} for n in names}
    for i, (a, b) in enumerate(pairs):
        both = {WHOLE_FILES[a], WHOLE_FILES[b]}
        assert got[100 + i] == both and both <= got[200 + i] <= both | {"GPL", "LGPL"}


def test_titles_and_denials(spark):
    want = {
        "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n": "GPL-3.0",
        "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n\nSee the GNU Lesser General Public License.": "AGPL-3.0",
        "Eclipse Public License - v 2.0\n\nTHE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\").": "EPL-2.0",
        "This file is not licensed under the MIT license.": "",
        "It isn't available under the terms of the GPL.": "",
        "It is not released under the GPL but licensed under the MIT license.": "MIT",
        "Do not use this file except under the terms of the MIT license.": "MIT",
        "Published under the GNU Free Documentation License, Version 1.2.": "GFDL-1.2",
    }
    rows = list(enumerate(want))
    got = {r.doc_id: r.licenses for r in license_scan.license_scan(frame(spark, rows)).collect()}
    assert {text: got[i] for i, text in rows} == want


def test_many_licenses_by_name(spark):
    rows = [(i, f"This work is made available under the terms of\nthe {row[1]}.") for i, row in enumerate(license_scan.NAMES)]
    got = {r.doc_id: r.licenses for r in license_scan.license_scan(frame(spark, rows)).collect()}
    assert len(rows) >= 60 and got == {i: row[0] for i, row in enumerate(license_scan.NAMES)}


def test_rollup(spark, tmp_path):
    rollup = token_rollup.TokenRollup(spark, f"file://{tmp_path}/r")
    schema = "kind string, source string, lang string, tokenizer string, old_tokens long, new_tokens long, extra string"
    batch = lambda *rows: spark.createDataFrame([(*r, "x") for r in rows], schema)
    totals = lambda: {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in rollup.totals().collect()}
    assert totals() == {}
    first = batch(("insert", "a", "en", "v1", None, 10), ("insert", "a", "en", "v1", None, 5), ("insert", None, "en", "v1", None, None))
    assert rollup.commit("one", first) and not rollup.commit("one", first)
    assert totals() == {("a", "en", "v1"): (2, 15), (None, "en", "v1"): (1, 0)}
    assert rollup.commit("two", batch(("revise", "a", "en", "v1", 5, 7), ("delete", None, "en", "v1", None, None), ("insert", "a", "en", "v2", None, 3)))
    assert totals() == {("a", "en", "v1"): (2, 17), ("a", "en", "v2"): (1, 3)}
    # an attempt that died before its record leaves deltas that are not counted, and is written over
    batch(("insert", "z", "en", "v1", None, 1)).selectExpr("'three' AS batch", "source", "lang", "tokenizer", "1L AS docs", "new_tokens AS tokens").write.parquet(rollup._folder("three"))
    assert ("z", "en", "v1") not in totals()
    assert rollup.commit("three", batch(("delete", "a", "en", "v1", 10, None)))
    assert totals()[("a", "en", "v1")] == (1, 7)
    before = totals()
    assert rollup.compact("base") and not rollup.compact("base") and totals() == before
    assert not rollup.commit("one", first) and rollup.commit("empty", batch()) and totals() == before
    with pytest.raises(Exception, match="not a kind"):
        rollup.commit("bad", batch(("upsert", "a", "en", "v1", 1, 2)))


@pytest.mark.parametrize("shard", [8192, 16])
def test_top_k(spark, shard):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 0.3) for _ in range(12)]) for i in range(150)]
    rows += [(200 + i, list(rows[i][1])) for i in range(20)] + [(300, None), (305, [None] * 12), (310, [float("nan")] * 12), (315, [float("inf")] * 12), (None, [0.1] * 12), (320, [0.0] * 12), (325, [5e7] + [0.0] * 11), (20, [9.0] * 12), (20, [9.0] * 12), (330, [0.5, -0.25])]
    df = spark.createDataFrame([(i, v, 0, 1.0) for i, v in rows], "vec_id long, embedding array<float>, q int, score double")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk_search.top_k(df, F.col("vec_id") % 5 == 0, k=7, shard=shard).collect())
    assert got == brute.top_k([(r.vec_id, r.embedding) for r in df.collect()], 5, 7)
    few = df.filter("vec_id < 3")
    assert topk_search.top_k(few, F.col("vec_id") == 0, k=7).count() == 2
    assert topk_search.top_k(df.limit(0), F.col("vec_id") == 0).collect() == []


def test_max_score_prunes_and_stays_exact():
    """Large integers take the exact path; few terms are essential when one term outweighs the rest."""
    import numpy as np

    rnd = np.random.default_rng(1)
    vectors = rnd.integers(-5, 6, (5000, 16))
    vectors[:, 0] *= 100_000
    ids = np.arange(5000)
    for kind in (np.float64, object):
        shard = topk_search.Shard(ids, ids, vectors.astype(kind))
        q, places, scores = shard.search(np.arange(6), vectors[:6].astype(kind), 10)
        for i in range(6):
            whole = vectors @ vectors[i]
            order = sorted((-int(whole[j]), j) for j in range(5000) if j != i)[:10]
            assert [(-int(a), int(b)) for a, b in zip(scores[q == i], places[q == i], strict=True)] == order
    huge = vectors.astype(object) * 10**12
    _, places, scores = topk_search.Shard(ids, ids, huge).search(np.arange(1), vectors[:1].astype(np.float64), 3)
    assert list(scores) == sorted((huge @ vectors[0].astype(object)).tolist()[1:], reverse=True)[:3]


def test_postings_hold_each_sign():
    import numpy as np

    block = topk_search.Block(np.array([[2.0, -1.0], [0.0, 3.0], [-4.0, 0.0]]))
    assert block.postings.tolist() == [[2, 0, 0], [0, 3, 0], [0, 0, 4], [1, 0, 0]] and block.largest.tolist() == [2, 3, 4, 1]


def test_a_score_beyond_long_is_an_error(spark):
    df = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1.0, 1.0]), (2, [1e-30, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="(?i)overflow|too (big|large)|convert"):
        topk_search.top_k(df, F.col("vec_id") == 0).collect()
    assert [r.vec_id for r in topk_search.top_k(df, F.col("vec_id") == 2, k=1).collect()] != []


def test_marginals_do_not_depend_on_segments(monkeypatch):
    pick = np.random.default_rng(4)
    sizes = [1, 2, 3, 0, 7, 40, 1, 129]
    offs = np.concatenate([[0], np.cumsum(sizes)])
    score, move = pick.normal(size=offs[-1]) * 3, pick.normal(size=(2, 2))
    whole, pairs = quality_crf.marginals(score, move, offs)
    for segment in (1, 2, 5, 64):
        monkeypatch.setattr(quality_crf, "SEGMENT", segment)
        p, q = quality_crf.marginals(score, move, offs)
        assert np.allclose(p, whole) and np.allclose(q, pairs)


def test_features_do_not_depend_on_pieces(monkeypatch):
    texts = ["One line.\n\ntwo  Two two\n#x# $", "", "\n", "a\n\n\nbc d.\n", "é É 12\r\nlast"] * 3
    raw = [t.encode() for t in texts]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    x, size, lines = quality_crf.line_features(data, offs)
    assert size.tolist() == [len(line) for r in raw for line in r.split(b"\n")] and np.diff(lines).tolist() == [r.count(b"\n") + 1 for r in raw]
    monkeypatch.setattr(quality_crf, "PIECE", 2)
    assert np.array_equal(quality_crf.line_features(data, offs)[0], x)


def test_a_text_of_a_million_lines(spark):
    import time

    rows = [(i, ("A good line of words.\n" * 3 if i % 2 else "### $$ 1 1 1\n" * 3), "en", "s", 1) for i in range(40)] + [(1000, "\n" * 1_000_000, "en", "s", 1), (1001, "Fine words here.\n" * 60_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    model = quality_crf.train(docs, labels)
    data = np.full(1_000_000, 0x0A, np.uint8)
    began = time.time()
    score, lines, _ = model.documents(data, np.array([0, len(data)]))
    assert lines[0] == 1_000_001 and 0 <= score[0] <= 1 and time.time() - began < 10
    got = {r.doc_id: r for r in quality_crf.quality_scores(docs, labels).collect()}
    assert got[1000].n_lines == 1_000_001 and got[1001].predicted == 1 and len(got) == 42
    assert {r.doc_id for r in quality_crf.keep_good(docs, labels).select("doc_id").collect()} == {i for i, r in got.items() if r.predicted}
