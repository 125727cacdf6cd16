"""Operators 1, 6, 8 and 9 against plain Python, with the odd inputs that each must bear."""

import hashlib
import random
import re

from pyspark.sql.functions import lit as F_lit

from biblioloom.llm import chat, licenses, pii, secret_scan, url_filters


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_url_filters(spark):
    urls = [
        "https://A.b.NET/x?q=1", "http://net/en/1", "https://x.example.net/en/5", "https://example.net/en", "https://example.com/de/",
        "http://w.example.org/fr/9#t", "nothing", None, "", "ftp://host", "x://?a", "https://a.net", "https://a.net", "http://notexample.com/de/",
    ]
    pages = spark.createDataFrame([(i, u, "h", "clash", "t") for i, u in enumerate(urls)], "page_id long, url string, html string, rule string, tokens string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in url_filters.judge(pages, labels).collect()}
    assert len(got) == len(urls)

    def brute(u):
        if u is None or "://" not in u:
            return "", "", None
        rest = u.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = host.lower()
        fits = [r for r in url_filters.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        return host, path, best

    for i, u in enumerate(urls):
        host, path, best = brute(u)
        assert (got[i]["host"], got[i]["path"]) == (host, path)
        assert got[i]["rule"] == (best[0] + best[1] if best else None)
        assert got[i]["verdict"] == (best[2] if best else "allow")


def test_url_rules_are_mined(spark):
    rows = [(i, f"https://{'good' if i % 3 else 'bad'}.site.io/p/{i}") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), None) for i in range(30)] + [(None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r["verdict"] for r in url_filters.judge(pages, labels).collect()}
    assert got == {i: "allow" if i % 3 else "block" for i, _ in rows}


def test_url_rules_need_more_than_chance(spark):
    """A token with the share of bad URLs at large makes no rule; twenty shared tokens do not make 2**20 combinations."""
    shared = "/".join(f"s{chr(97 + i)}" for i in range(20))
    r = random.Random(4)
    rows = [(i, f"https://h{chr(97 + i % 7)}.io/{shared}/{'x' if i % 2 else 'y'}{'/spam' if i % 5 == 0 else ''}/{i}") for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 5 > 0 and r.random() < 0.85), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {x["page_id"]: x for x in url_filters.judge(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()}
    blocked = {i for i, x in got.items() if x["verdict"] == "block"}
    assert {i for i in range(200) if i % 5 == 0} <= blocked and len(blocked) < 70
    assert "p:spam" in got[0]["mined_rule"] and got[0]["confidence"] == 1.0 and got[0]["lift"] > 2
    same = spark.createDataFrame([(["a", "b"], 1), (["a"], 0), (["a", "b"], 0), (None, 1)] * 20, "tokens array<string>, bad int")
    assert url_filters.mine(same).collect() == []
    told = spark.createDataFrame([(["a", "b"], 1), (["a"], 0), (None, 1)] * 20, "tokens array<string>, bad int")
    assert sorted((x["antecedent"], x["urls"]) for x in url_filters.mine(told).collect()) == [(["a", "b"], 20), (["b"], 20)]


def test_url_rules_of_more_than_eight_tokens(spark):
    """Bad URLs hold twelve tokens, each of which good ones hold too, all but one of them: only the whole combination tells."""
    t = [f"p:{chr(97 + i)}" for i in range(12)]
    rows = [(t, 1)] * 40 + [(t[:i] + t[i + 1 :], 0) for i in range(12) for _ in range(30)] + [(["q:z"], 0)]
    found = {tuple(x["antecedent"]): (x["confidence"], x["urls"]) for x in url_filters.mine(spark.createDataFrame(rows, "tokens array<string>, bad int")).collect()}
    assert found[tuple(t)] == (1.0, 40)
    # tokens that the same URLs hold make one rule, which each of them stands for
    same = [f"p:{chr(97 + i)}{chr(97 + i)}x" for i in range(26)]
    rows = [(same, 1)] * 20 + [(["q:z"], 0)] * 30
    rules = url_filters.mine(spark.createDataFrame(rows, "tokens array<string>, bad int"))
    assert [(x["antecedent"], x["alike"]) for x in rules.collect()] == [(same[:1], [same])]
    urls = spark.createDataFrame([("u", same[3:5]), ("v", ["q:z"]), ("w", [same[7], "q:z"])], "url string, tokens array<string>")
    assert {x["url"]: x["_m"]["mined_rule"] for x in url_filters.matched(urls, rules).collect()} == {"u": same[3], "w": same[7]}


def test_url_filters_on_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filters.judge(pages, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def test_licences(spark):
    rows = [
        (1, "Foo. Released under the MIT License.\nBar", "", "", 0),
        (2, "THIS WORK IS LICENSED*** under the GNU General Public License, version 3!\nAll rights reserved.", "", "", 0),
        (3, None, None, None, None), (4, "", "", "", 0), (None, "Licensed under CC BY-NC 4.0.", "", "", 0),
        (5, "see the licence", "", "", 0), (5, "see the licence", "", "", 0),
        (6, "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Foo. "
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
            "documentation and/or other materials provided with the distribution.", "", "", 0),
        (7, "word " * 20000 + "\nReleased under the MIT License", "", "", 0),
    ]
    got = [(r["doc_id"], r["licence"]) for r in licenses.scan(docs(spark, rows)).collect()]
    want = [(1, "MIT"), (2, "GPL-3.0"), (3, None), (4, None), (None, "CC-BY-NC-4.0"), (5, None), (5, None), (6, "BSD-2-Clause"), (7, "MIT")]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert licenses.scan(docs(spark, [])).collect() == []
    low = [s for s in licenses.SENTENCES if not re.search(licenses.CUE, s)]
    assert not low
    assert {i for r in licenses.RULES for i in r[2]} <= set(licenses.SENTENCES.values())


MIT = """MIT License

Copyright (c) 2020 Ada

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE.
"""
BSD = """Copyright (c) 2020, Ada
All rights reserved.

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""


GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""
ZLIB = """This software is provided 'as-is', without any express or implied warranty.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this file,
You can obtain one at https://mozilla.org/MPL/2.0/.
"""


def test_wrapped_licences(spark):
    whole = [(MIT, "MIT", "mit-text"), (BSD, "BSD-2-Clause", "bsd-2-clause-text"), (BSD3, "BSD-3-Clause", "bsd-3-clause-text"), (GPL, "GPL", "gpl-header"), (GPL3 + "\n" + GPL, "GPL-3.0", "gpl-3.0-header"), (ZLIB, "Zlib", "zlib-grant"), (MPL, "MPL-2.0", "mpl-2.0-header")]
    narrow = GPL.replace(" ", "\n")
    marks = [lambda t, m=m: "".join(m + line for line in t.splitlines(True)) for m in ("", " * ", "# ", "// ", "-- ")]
    cases = [(mark(t), name, rule) for t, name, rule in whole for mark in marks] + [(t.replace("\n", "\r\n"), n, r) for t, n, r in whole] + [(narrow, "GPL", "gpl-header")]
    apart = "This program is distributed in the hope that it will be useful,\n\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY."
    table = docs(spark, [(i, t, "", "", 0) for i, (t, _, _) in enumerate([*cases, (apart, None, "")])])
    got = {r["doc_id"]: r for r in licenses.scan(table).collect()}
    for i, (t, name, rule) in enumerate(cases):
        assert got[i]["licence"] == name and rule in got[i]["rules"].split(","), t
    assert got[len(cases)]["licence"] is None


def test_a_licence_in_a_text_of_very_many_short_lines(spark):
    """Lines that begin like a known sentence, again and again; no array of runs grows with them."""
    wrapped = "Licensed\nunder the\nMIT\nLicense"
    texts = ["this\nwork\n" * 50000 + wrapped, "this\n" * 100000 + wrapped, "a b\n" * 100000 + wrapped + "\n" + "the\n" * 1000 + "license permission"]
    got = {r["doc_id"]: r for r in licenses.scan(docs(spark, [(i, t, "", "", 0) for i, t in enumerate(texts)])).collect()}
    for i in range(len(texts)):
        assert got[i]["licence"] == "MIT" and got[i]["sentence_ids"] == "mit-notice,mit-title"


def test_chat_turns_that_differ_only_in_parts(spark):
    kind = "conv_id long, turn int, role string, text string, parts array<struct<type:string,text:string,uri:string,units:int>>"
    rows = [(1, 1, "user", "x", [("image", None, u, n)]) for u in ("b", "a", None) for n in (2, 1)] + [(1, 1, "user", "x", None)]
    made = {str(chat.format_conversations(spark.createDataFrame(own, kind).repartition(n)).collect()) for own, n in ((rows, 1), (rows[::-1], 1), (rows, 7), (rows[3:] + rows[:3], 3))}
    assert len(made) == 1


def test_chat_round_trip(spark):
    hard = ["\\### Assistant: </turn> ok", "a & b < c <|turn|>x<|text|>y<|end|>\n", "&lt;&amp;lt;", "<|end|>", "", None, "é\U0001f600" * 3, "x" * 200_000, "\n\n", "\\"]
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "assistant", "sys<|tem", None]), r.choice(hard)) for c in range(20) for t in range(r.randint(1, 6))]
    rows += [(None, 0, "user", "lost"), (5, 0, "user", "again"), (5, 0, "user", "again"), (6, None, "assistant", "no turn")]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {x["conv_id"]: x for x in chat.digest(chat.with_extra(table.withColumn("formatted", table["text"]))).collect()}
    groups = {}
    for c, t, role, text in [*rows, (-7, 0, "user", chat.EXTRA), (-7, 1, "assistant", chat.EXTRA)]:
        groups.setdefault(c, []).append((t if t is not None else -1, role or "", text or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        told = "".join(f"{a}\n{b}\n" for _, a, b in turns)
        loss = "".join(b for _, a, b in turns if a == "assistant")
        x = got[c]
        assert x["n_turns"] == len(turns) and x["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert x["loss_chars"] == len(loss) and x["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_parts(spark):
    part = "array<struct<type:string,text:string,uri:string,units:int>>"
    parts = [("text", "see <", None, None), ("image", None, "s3://a", 2), ("audio", None, "b", 3), ("text", "!", None, None), ("document", None, "c", None)]
    table = spark.createDataFrame([(1, 0, "user", None, parts), (1, 1, "assistant", None, None)], f"conv_id long, turn int, role string, text string, parts {part}")
    x = chat.format_conversations(table).collect()[0]
    assert "see &lt;<|image:0|><|audio:1|>!<|document:2|>" in x["formatted"]
    assert [tuple(a) for a in x["attachments"]] == [("image", "s3://a"), ("audio", "b"), ("document", "c")]
    assert x["attachment_tokens"] == 2 * 256 + 3 * 32 + 512


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(s):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(s))) % 10 == 0


CHECKS = {
    "email": lambda s: True, "ip": lambda s: all(int(x) <= 255 for x in s.split(".")),
    "card": lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s)), "phone": lambda s: 10 <= len(digits(s)) <= 15,
}


def base_spans(text):
    found = [(m.start(), k, m.end()) for k, kind in enumerate(PATTERNS) for m in re.finditer(PATTERNS[kind], text) if CHECKS[kind](m.group())]
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))


def odd_texts():
    r = random.Random(11)
    atoms = ["a.b@c.d", "x@y.z+d@e.f", "@@", "1.2.3.4", "256.1.1.1", "000255.1.2.3.4.5.6.7", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (555) 123-4567",
             "+1234567890123456", "é", "\U0001f600", " ", "\n", "12", "-", "4111111111111111", "+", "00000000000000", "a@b", "\x01", "1 2 3 4 5 6 7 8 9 0 1 2 3 4"]
    out = ["".join(r.choices(atoms, k=r.randint(1, 12))) for _ in range(400)]
    return [*out, "", "a" * 100_000, "1" * 100_000, "1 " * 30_000, "a@" * 20_000, "+1(" * 20_000, "x@y.z " * 800, "a" * 100_000 + " b@c.d", "a@" + "b." * 40_000 + "c", "1." * 40_000]


def test_pii_base_spans(spark):
    texts = odd_texts()
    rows = [(i, t, "", "", 0) for i, t in enumerate(texts)] + [(None, "me@here.org", "", "", 0), (7_000, None, None, None, None)]
    got = {r["doc_id"]: r for r in pii.find(docs(spark, rows), pii.Boosted([], {})).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t)
        assert got[i]["spans"] == want, t[:80]
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x.startswith(k + ":") for x in want.split(",")) for k in pii.KINDS]
    assert got[None]["spans"] == "email:0:11" and got[7_000]["spans"] == ""
    assert pii.find(docs(spark, []), pii.fit(docs(spark, []))).collect() == []


def test_pii_redaction(spark):
    rows = [(1, "mail me@x.org or +1 (555) 123-4567.", "en", "s", 36), (2, None, None, None, None), (3, "nothing", "en", "s", 7)]
    out = {r["doc_id"]: r for r in pii.redact(docs(spark, rows), pii.Boosted([], {})).collect()}
    assert out[1]["text"] == "mail [EMAIL] or [PHONE]." and out[1]["n_chars"] == len(out[1]["text"])
    assert out[2]["text"] is None and out[3]["text"] == "nothing" and out[3]["n_chars"] == 7


def test_boosting_learns_and_calibrates():
    import numpy as np

    r = np.random.default_rng(0)
    x = r.integers(0, 5, (600, len(pii.FEATURES))).astype(float)
    kinds = r.integers(0, 2, 600)
    y = ((x[:, 4] > 2) & (x[:, 10] > 1)).astype(float)
    model = pii.train(x, y, kinds)
    s = sum(pii.score(t, x) for t in model.trees)
    assert set(model.thresholds) == {0, 1}
    for k, t in model.thresholds.items():
        mine = kinds == k
        assert y[mine][s[mine] >= t].mean() >= 0.97
    assert "CASE WHEN p.digits" in model.sql("p") and pii.Boosted([], {}).accepts("p") == "false"


def test_pii_adds_spans_beyond_the_base(spark):
    """Precision and recall on made texts of another seed, and sentences of another make."""
    model = pii.fit(docs(spark, []))
    assert {0, 2, 3} <= set(model.thresholds)
    made = pii.made_texts(400, 77)
    rows = pii.with_spans(docs(spark, [(i, t, "", "", 0) for i, (t, _) in enumerate(made)]), model).select("doc_id", "_base", "_spans").collect()
    right = wrong = 0
    for r in rows:
        base = set(map(tuple, r["_base"]))
        for x in set(map(tuple, r["_spans"])) - base:
            s, k, e = x
            hit = any(k == kind and s < b and a < e for kind, a, b in made[r["doc_id"]][1])
            right += hit
            wrong += not hit
    assert right / (right + wrong) >= 0.97 and right >= 0.8 * sum(len(h) for _, h in made)
    found = [
        ("Please call 030 5551234 before noon.", "phone"), ("His mobile is 0171-5558899, she said", "phone"), ("Tel. (415) 555-2671", "phone"),
        ("Write to jane.doe (at) example (dot) org today", "email"), ("pay with card 4111.1111.1111.1111 now", "card"),
    ]
    clean = ["Between 1998-2004 the price was 1.250.000 in all", "ISBN 978-3-16-148410-0 on page 120-145", "On 2021-03-04 version 10.2.4471 came out", "order 123456789012 of 12 300 450 items", "npm install left@417", "", None]
    got = {r["doc_id"]: r["spans"] for r in pii.find(docs(spark, [*((i, t, "", "", 0) for i, (t, _) in enumerate(found)), *((100 + i, t, "", "", 0) for i, t in enumerate(clean))]), model).collect()}
    assert [got[i].split(":")[0] for i in range(len(found))] == [k for _, k in found]
    assert [got[100 + i] for i in range(len(clean))] == [""] * len(clean)


def test_pii_redacts_many_spans_and_odd_columns(spark):
    import time

    none = pii.Boosted([], {})
    many = " ".join(f"a{i}@b.com x" for i in range(8000))
    kind = "doc_id long, text string, _text string, _new string, _row string, _spans map<string,int>, n_chars long"
    rows = [(1, many, "secret", "b", "c", {"k": 1}, 7), (None, None, None, None, None, None, None), (1, "", "x", "y", "z", None, 0), (2, "me@b.org", "x", "y", "z", None, 8)]
    table = spark.createDataFrame(rows, kind)
    pii.redact(table.limit(1), none).collect()
    began = time.time()
    out = pii.redact(table, none)
    got = out.collect()
    assert time.time() - began < 20
    assert out.columns == table.columns and out.dtypes == table.dtypes
    first = next(r for r in got if r["n_chars"] and r["n_chars"] > 100)
    assert first["text"] == " ".join("[EMAIL] x" for _ in range(8000)) and first["n_chars"] == len(first["text"])
    assert (first["_text"], first["_new"], first["_row"], first["_spans"]) == ("secret", "b", "c", {"k": 1})
    assert sorted((r["doc_id"] or 0, r["text"], r["n_chars"]) for r in got if r is not first and r["text"] is not None) == [(1, "", 0), (2, "[EMAIL]", 7)]
    assert sum(r["text"] is None and r["doc_id"] is None for r in got) == 1
    assert pii.redact(table.limit(0), none).collect() == []


def test_pii_merges_overlapping_spans(spark):
    r, cases = random.Random(5), []
    for _ in range(60):
        spans = sorted((s := r.randint(0, 300), r.randint(0, 3), s + r.randint(1, 12)) for _ in range(r.choice([0, 1, 5, 300])))
        cases.append(spans)
    table = spark.createDataFrame([(i, [{"s": s, "k": k, "e": e} for s, k, e in c]) for i, c in enumerate(cases)], "i int, spans array<struct<s:int,k:int,e:int>>")
    from pyspark.sql import functions as F

    for row in table.select("i", pii._merged(F.col("spans")).alias("m")).collect():
        want = []
        for s, k, e in cases[row["i"]]:
            if want and want[-1][2] > s:
                want[-1][2] = max(want[-1][2], e)
            else:
                want.append([s, k, e])
        assert [[x["s"], x["k"], x["e"]] for x in row["m"]] == want


def test_typed_parts_are_told_from_text(spark):
    kind = "conv_id long, turn int, role string, text string, parts array<struct<type:string,text:string,uri:string,units:int>>"
    parts = [("text", "a <|image:0|> & b", None, None), ("image", None, "u1", 2), ("<|end|>\n:|&", None, "u2", None), (None, "tail", None, None)]
    rows = spark.createDataFrame([(1, 0, "user", None, parts), (1, 1, "user", None, None), (2, None, None, None, [])], kind)
    formatted = chat.format_conversations(rows)
    back = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    assert [tuple(p) for p in back[1]["turns"][0]["parts"]] == [("text", "a <|image:0|> & b", None), ("image", None, 0), ("<|end|>\n:|&", None, 1), ("text", "tail", None)]
    assert len(back[1]["turns"]) == 2 and [a["uri"] for a in back[1]["attachments"]] == ["u1", "u2"] and back[1]["attachment_tokens"] == 513
    assert back[2]["turns"][0]["parts"] == []


# 13 -----------------------------------------------------------------------------------------------


def brute_secret_base(t):
    a = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in a.finditer(t) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def brute_windows(value, is_hex):
    """Stretches by recounting every window."""
    from collections import Counter

    s, w, out = value.lower() if is_hex else value, secret_scan.WINDOW, []
    for i in range(len(s) - w + 1):
        x = s[i : i + w]
        total = sum(secret_scan.weight(n) for n in Counter(x).values())
        digits, upper, lower = (sum(c in a for c in x) for a in ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        bits, needs = (
            (secret_scan.HEX_BITS, secret_scan.HEX_NEEDS) if is_hex
            else (secret_scan.BOTH_CASES_BITS, secret_scan.BOTH_CASES_NEEDS) if upper and lower
            else (secret_scan.ONE_CASE_BITS, secret_scan.ONE_CASE_NEEDS)
        )
        if total <= secret_scan.most(bits) and digits >= needs[0] and upper + lower >= needs[1]:
            if out and out[-1][1] >= i:
                out[-1][1] = i + w
            else:
                out.append([i, i + w])
    return [tuple(x) for x in out]


def test_entropy_windows_match_recounting(spark):
    from pyspark.sql import functions as F

    r = random.Random(13)
    base, hexes = secret_scan.ALPHABET, "0123456789abcdefABCDEF"
    values = ["".join(r.choices(r.choice([base, base[:36], "abc123", "aB3", hexes]), k=r.randint(20, 90))) for _ in range(120)]
    values += ["".join(r.choices("ab1", k=200)) + "".join(r.choices(base, k=40)) + "a1B" * 60 + "".join(r.choices(base, k=30)), "a" * 20, "Z9" * 5000 + "".join(r.choices(base, k=50))]
    rows = spark.createDataFrame([(v, set(v) <= set(hexes)) for v in values], "v string, h boolean").withColumn("w", secret_scan.windows(F.col("v"), F.col("h"))).collect()
    hit = 0
    for x in rows:
        want = brute_windows(x["v"], x["h"])
        assert [(w["s"], w["e"]) for w in x["w"]] == want, x["v"]
        hit += bool(want)
    assert 20 < hit < 120


def test_secrets(spark):
    r = random.Random(31)
    base64, hexes = secret_scan.ALPHABET[:64], "0123456789abcdef"
    draw = lambda a, n: "".join(r.choices(a, k=n))
    texts = [
        None, "", 'Token="abcdef"', "token=token: abcdef", "api_key : 'x1.y=/+-_' and APIKEY=12345", "passwd=" + " " * 50 + "secret1", "é\U0001f600 ſecret=abcdefg toKen=abcdefg",
        "AKIA" + draw("ABC123", 16) + " AKIAABC xAKIAAKIA" + draw("ABC123", 20), draw(hexes, 24) + "g" + draw(hexes, 23) + " " + draw(hexes, 40), "password password= =secret==abcdefgh",
        "token=" * 2000 + "abcdefg", draw(hexes, 5000), "a1" * 30000,
    ]
    table = docs(spark, [(i, t, "", "", 0) for i, t in enumerate(texts)] + [(None, texts[2], "", "", 0), (2, texts[2], "", "", 0)])
    got = secret_scan.find(table.withColumn("_text", F_lit("clash")).withColumn("spans", F_lit("clash"))).collect()
    assert len(got) == len(texts) + 2
    for x in got:
        t = texts[x["doc_id"]] if x["doc_id"] is not None else texts[2]
        want = brute_secret_base(t or "")
        shown = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert x["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
        assert (x["n_assign"], x["n_access"], x["n_hex"]) == tuple(sum(k == i for _, k, _ in want) for i in range(3))
        assert set(filter(None, shown.split(","))) <= set(x["spans"].split(","))
    assert secret_scan.find(docs(spark, [])).count() == 0


def test_secrets_beyond_the_base(spark):
    r = random.Random(5)
    base64 = secret_scan.ALPHABET[:64]
    draw = lambda a, n: "".join(r.choices(a, k=n))
    planted = [f"the key é is {draw(base64, 40)} here" for _ in range(60)] + [f"id {draw('0123456789ABCDEF', 40)}." for _ in range(20)] + [f"k={draw('abcdefghijklmnopqrstuvwxyz0123456789', 40)}" for _ in range(20)]
    planted = [t for t in planted if not re.search("AKIA|[0-9a-f]{24}", t)]
    clean = [
        "Donaudampfschifffahrtsgesellschaftskapitaen", "see https://a.org/2024/05/17/some-long-article-title-about-nothing-9", "getUserAccountSettingsByIdentifier2", "550e8400-e29b-41d4-a716-446655440000",
        "sha256: " + draw(base64, 44), "commit " + draw("0123456789ABCDEF", 40), "data:image/png;base64," + draw(base64, 80), "key YOUR_API_KEY_EXAMPLE_1a2B3c4D5e", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
        "12345678901234567890123456789", "ab" * 30 + "1", "2024-01-02T03-04-05_backup_of_the_server", "---------------------------------", "x" * 5000,
    ]
    rows = secret_scan.findings(docs(spark, [(i, t, "", "", 0) for i, t in enumerate(planted + clean)])).where("kind = 'entropy'").collect()
    found = {x["doc_id"] for x in rows}
    assert len([i for i in found if i < len(planted)]) >= 0.97 * len(planted)
    assert not [clean[i - len(planted)] for i in found if i >= len(planted)]
    for x in rows:
        assert planted[x["doc_id"]][x["start"] : x["start"] + 4] == x["masked"][:4] and set(x["masked"][4:]) == {"*"}
