"""Licenses, secrets and personal data against plain brute force."""

import difflib
import hashlib
import random
import re

import pytest

from tests.llm.conftest import words
from tidemill.llm import licenses, pii, secrets


# -- licenses ------------------------------------------------------------------

def test_increasing_and_align():
    rng = random.Random(1)
    for _ in range(100):
        values = [rng.randrange(30) for _ in range(rng.randrange(0, 9))]
        best = max((len(s) for s in subsequences(values) if all(a < b for a, b in zip(s, s[1:]))), default=0)
        got = [values[i] for i in licenses.increasing(values)]
        assert len(got) == best and all(a < b for a, b in zip(got, got[1:]))
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(0, 20))] for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < r[0] and p[1] < r[1] for p, r in zip(pairs, pairs[1:]))
    a = list(range(100))
    b = a[:20] + [500, 501] + a[25:60] + a[61:]
    assert len(licenses.align(a, b)) == sum(m.size for m in difflib.SequenceMatcher(None, a, b, False).get_matching_blocks())


def subsequences(values):
    out = [[]]
    for v in values:
        out += [s + [v] for s in out]
    return out


def test_notices_are_found_whole_and_changed(docs):
    rng = random.Random(2)
    prose = lambda n: words(rng, n)
    apache = licenses.TEMPLATES[3][1]
    changed = apache.replace("except", "but").replace("License at", "text at").upper()
    pairs = [(1, f"{prose(50)}\nReleased under the MIT License.\n{prose(50)}"), (2, f"{prose(9)} {changed} {prose(9)}"),
             (3, prose(300)), (4, "the license of the version of the work under the public"), (5, ""), (6, None),
             (7, "é Released under the MIT License. x Released under the MIT License."), (7, "twice"), (None, apache),
             (8, ("filler " * 30_000) + "Licensed under CC BY-NC 4.0."), (9, "mit the under released")]
    got = licenses.licenses(docs(pairs)).collect()
    found = sorted(((r.doc_id, r.license) for r in got), key=str)
    assert found == sorted([(1, "MIT"), (2, "Apache-2.0"), (7, "MIT"), (7, "MIT"), (None, "Apache-2.0"), (8, "CC-BY-NC-4.0")], key=str)
    texts = {i: t for i, t in pairs if t != "twice"}
    for r in got:
        assert 0.8 <= r.coverage <= 1
        if r.doc_id in (1, 7):
            assert texts[r.doc_id][r.start:r.end] == "Released under the MIT License"
    assert licenses.licenses(docs([])).count() == 0
    own = licenses.licenses(docs([(1, "use it as you like my friend")]), [("Own", "Use it as you like, my friend!")])
    assert [(r.license, r.coverage) for r in own.collect()] == [("Own", 1.0)]


def names_in(text):
    import numpy as np
    import pyarrow as pa
    known = licenses.Templates()
    rows = licenses.word_rows(pa.array([text]))[0]
    return [known.names[f[0]] for f in known.find(rows, np.flatnonzero(np.isin(rows, known.all_rare)))]


def test_kin_of_a_license_are_not_taken_for_it():
    long = licenses.TEMPLATES[5][1]
    assert names_in("Released under the GPL License") == []
    assert names_in("Licensed under CC BY 4.0.") == ["CC-BY-4.0"] and names_in("Licensed under CC BY-NC 4.0.") == ["CC-BY-NC-4.0"]
    assert names_in(long) == ["GPL-3.0"] and names_in(long.replace("version 3", "version 2")) == ["GPL-2.0"]
    assert names_in(long.replace("GNU General", "GNU Lesser General")) == ["LGPL-3.0"]
    for template in licenses.TEMPLATES:
        assert names_in(f"some words {template[1]} and more") == [template[0]], template
    copy = "Released under the MIT License. "
    assert names_in("word " + copy * 2 + "end") == ["MIT"] * 2 and names_in("word " + copy * 3) == ["MIT"] * 3


# -- secrets -------------------------------------------------------------------

def base_secrets(text):
    found = [("assign", m.start(), m.end()) for m in re.finditer(
        "(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A)
        if len(m.group(2)) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(found, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


KEY = "wJalrXUtnFEMIaK7MDENGbPxRfiCYEXAMPLEKEY9"
SECRETS = [
    (1, "token = abcdef, secret: tiny = password=12345678"), (2, "AKIAAKIA" + "B" * 20 + " AKIASHORT"), (3, "f" * 23 + " " + "0a" * 40),
    (4, None), (5, ""), (6, "éé Api_Key='x/y+z=._-' TOKEN:'" + "a" * 30), (7, "paſſword=abcdefgh tokenK=1"), (7, "token=abcdef"),
    (None, "passwd : \"longenough\""), (8, ("pad " * 40_000) + "secret=abcdef123"), (9, "no thing here"),
    (10, f"access AKIA{'Z' * 16} and {KEY} at db.example.com:5432"), (11, f"just {KEY} alone"), (12, "server db.example.com:5432 alone"),
    (13, f"user: admin\n\n{KEY}"), (14, f"user: admin {KEY}"), (15, "user: bob token=abcdef https://api.example.com/v1"),
    (16, f"login=carol {'far ' * 200} {KEY}"),
]


def test_secret_spans(docs, spark, monkeypatch):
    source = docs(SECRETS)
    monkeypatch.setattr(secrets, "table", lambda *_: source)
    rows = secrets.op6_secrets(spark, "").collect()
    assert len(rows) == len(SECRETS)
    texts = {}
    for i, t in SECRETS:
        texts.setdefault(i, []).append(t or "")
    for r in rows:
        wanted = [",".join(f"{k}:{s}:{e}" for k, s, e in base_secrets(t)) for t in texts[r.doc_id]]
        digests = [hashlib.sha256(w.encode()).hexdigest() for w in wanted]
        assert r.base_sha256 in digests
        spans = [s for s in r.spans.split(",") if s]
        assert set(wanted[digests.index(r.base_sha256)].split(",")) - {""} <= set(spans)
    more = {r.doc_id: [s.split(":")[0] for s in r.spans.split(",") if s.split(":")[0] in secrets.WEAK] for r in rows}
    assert more[10] == ["key", "endpoint"]
    assert more[11] == [] and more[12] == [] and more[13] == [] and more[16] == []
    assert more[14] == ["user", "key"] and more[15] == ["user", "endpoint"]
    assert secrets.secrets(docs([])).count() == 0


def test_long_and_url_safe_parts_are_whole():
    key = "".join(random.Random(9).choices("abcdefghijkXYZUVW0123456789", k=400))
    user, url = "robot." * 30 + "x", "https://api.example.com/" + "p" * 600
    for own in (key, key[:50] + "-_" + key[50:80], key[:89] + "=="):
        text = f"{own}\nuser: {user}\n{url}"
        _, more = secrets.linked_spans(text)
        assert [(k, text[s:e]) for k, s, e in more] == [("key", own), ("user", user), ("endpoint", url)]
        assert secrets.pc.match_substring_regex(secrets.pa.array([own]), secrets._MAY).to_pylist() == [True]


def test_endpoints_of_any_length():
    host = ".".join(f"label{i}" * 20 for i in range(12))
    scheme = "averyveryverylongschemename+v2"
    for text, want in [
            (f"see {host}:8443 now", [f"{host}:8443"]), (f"({scheme}://db.example/x)", [f"{scheme}://db.example/x)"]),
            ("9http://a.b:80/c d.e:99", ["http://a.b:80/c", "d.e:99"]), ("a.b:80http://xyz1", ["http://xyz1", "a.b:80"]),
            ("x://abcd ://abcd a.b:123456 http://abc", []), ("A.b-c.d:22", ["A.b-c.d:22"]), ("", [])]:
        assert [text[a:b] for a, b in secrets.endpoints(text)] == want
    assert secrets.endpoints("a1" * 200_000 + "." * 1000 + "b." * 100_000) == []


def test_interval_join_is_the_plain_one():
    import numpy as np
    rng = random.Random(3)
    for _ in range(200):
        draw = lambda n: np.array([(s, s + rng.randrange(1, 9)) for s in
                                   sorted(rng.sample(range(0, 4000, 10), n))], dtype=np.int64).reshape(-1, 2)
        spans, others, scope = draw(5), draw(3), np.array(sorted(rng.sample(range(5, 4000, 10), 4)))
        got = secrets.meets(spans, others, scope)
        for (s, e), found in zip(spans, got, strict=True):
            k = int((scope <= s).sum())
            low, high = ([0, *scope][k], [*scope, 10**9][k])
            near = [(a, b) for a, b in others if b > max(low, s - secrets.REACH) and a < min(high, e + secrets.REACH)]
            assert found == bool(near)


# -- personal data ---------------------------------------------------------------

def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        v = int(c)
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_pii(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                  "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


PII = [
    (1, "mail a.b@c.de, x@y, a@b.c_d@e.f.g é z@z.zz"), (2, "ips 1.2.3.4 256.1.1.1 1.2.3.4.5 0001.02.3.255 99999999999999999999.1.1.1"),
    (3, "cards 4111 1111 1111 1111, 4111-1111-1111-1112, 4111111111111111 4111111111111111"), (4, None), (5, ""),
    (6, "+1 (017) 555-7713, +12345678, +44.20.7946.0958 then +1+23456789012"), (7, "same@mail.example"), (7, "same@mail.example"),
    (None, "no@id.example"), (8, "9" * 20_000 + " 1" * 9_000 + " " + "a" * 50_000 + " b.c" * 5_000 + "@d" + ".e" * 9_000),
    (9, "john (at) example.com and (555) 123-4567"), (10, "@@ .. 1..2 ++1 +1- 5"), (11, "line\n+1 555\n5557777 1.2.3\n.4 a\n@b.c"),
]


def test_pii_spans(docs, spark, monkeypatch):
    source = docs(PII)
    monkeypatch.setattr(pii, "table", lambda *_: source)
    df = pii.op8_pii(spark, "")
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    rows = df.collect()
    assert len(rows) == len(PII)
    texts = dict(PII)
    for r in rows:
        want = base_pii(texts[r.doc_id] or "")
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), r.doc_id
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in want) for kind in PATTERNS)
        assert r.spans.startswith(joined)


def test_pii_of_an_empty_table(docs):
    assert pii.personal_data(docs([])).count() == 0


def test_candidates_like_validated_ones_are_added_and_redacted(docs):
    rng = random.Random(4)
    pairs = []
    for i in range(200):
        phone = f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"
        pairs.append((i, f"{words(rng, 6)} phone {phone} {words(rng, 3)}"))
    # The same format and context, though the plus sign is written out.
    pairs.append((500, "call phone 1 (234) 555-9876 now"))
    pairs.append((501, "the year 1999 and 12 of 30"))
    found = {r.doc_id: r for r in pii.personal_data(docs(pairs)).collect()}
    assert [(s.kind, s.start) for s in found[500].added] == [("number", 11)]
    assert found[501].added == [] and found[3].added == []
    texts = {r.doc_id: r.text for r in pii.redacted(docs(pairs)).collect()}
    assert texts[500] == "call phone [number] now" and texts[501] == pairs[-1][1] and "[phone]" in texts[3]


def test_many_unvalidated_spans_are_still_added(docs):
    rng = random.Random(6)
    pairs = [(i, f"{words(rng, 4)} mail a{i}@example.com or +1 (234) 555-{1000 + i}") for i in range(200)]
    pairs += [(1000 + i, f"write to john{i} (at) example (dot) com or (555) 123-{1000 + i} today") for i in range(100)]
    pairs += [(2000 + i, f"order 1 (234) 555-{1000 + i} now") for i in range(60)]
    pairs += [(3000 + i, f"item {10**16 + i} of the list") for i in range(100)]
    found = {r.doc_id: [s.kind for s in r.added] for r in pii.personal_data(docs(pairs)).collect()}
    assert all(found[1000 + i] == ["mailbox", "number"] for i in range(100))
    assert all(found[2000 + i] == ["number"] for i in range(60))
    assert not any(found[3000 + i] for i in range(100))


@pytest.mark.parametrize("leaf", [0.1, 2.0])
def test_score_expression_is_the_model(spark, leaf):
    import numpy as np
    rng = np.random.default_rng(5)
    rows = rng.integers(0, 6, (400, len(pii.FEATURES))).astype(np.float32)
    model = pii.fit(rows, ((rows[:, 1] > 2) & (rows[:, 5] < leaf * 2)).astype(float), trees=6, depth=3)
    data = spark.createDataFrame([([int(x) for x in r],) for r in rows[:50]], "v array<int>")
    struct = pii.F.struct(*[pii.F.col("v")[i].alias(n) for i, n in enumerate(pii.FEATURES)])
    got = [r[0] for r in data.select(pii.score(model, struct)).collect()]
    assert got == pytest.approx(model.score(rows[:50]).tolist())
