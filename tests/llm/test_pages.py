import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from feedlake.llm.common import scratch_path
from feedlake.llm.templates import UNITS, contaminated, without_contaminated
from feedlake.llm.url_rules import PATTERNS, SITES, Rule, judge_urls, rule_index
from feedlake.llm.warc import fetch_records, plan_records, read_bundles, write_bundles

from .cases import no_docs, odd_docs

URLS = [None, "", "no scheme", "http://example.net", "http://example.net/", "https://A.Example.NET/en/x", "http://notexample.net/en/", "x://h.example.com/de/1?a=b",
        "http://example.com/DE/1", "http://a.org/fr/", "http://org/fr/q#z", "http://forg/fr/", "http://a.b/login", "http://a.b/help/login?x", "http://a.b/xlogin", "http://a.b/tag/q/page/2",
        "HTTP://A.B/LOGIN/", "http://a.b/c?sessionid=4", "http://a.b/c?xsessionid=4", "http://a.b://net/", "http://net:80/", "http://u\u212a.net/a", "http://a.b/\n/login"]


def plain_verdict(url):
    m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[2].translate({c: c + 32 for c in range(65, 91)}), m[3]) if m else ("", "")
    fits = []
    for r in SITES:
        h, _, p = r.text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append(r)
    if fits:
        best = max(fits, key=lambda r: len(r.text))
        return host, path, best.text, best.action
    low = (url or "").translate({c: c + 32 for c in range(65, 91)})
    hits = [r for r in PATTERNS if re.search(r.regex, low)]
    return host, path, None, max(hits, key=lambda r: (r.action == "allow", len(r.text))).action if hits else "allow"


def test_urls(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, URLS[4]), (4, URLS[4])]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, host string")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, SITES + PATTERNS).collect()), key=repr)
    assert got == sorted(((i, *plain_verdict(u)) for i, u in rows), key=repr)
    assert judge_urls(pages.where("false"), SITES).count() == 0 and judge_urls(pages, ()).where("verdict <> 'allow'").count() == 0


def test_rarest_token_is_the_key(spark):
    pages = spark.createDataFrame([(1, "http://a/common/x"), (2, "http://a/common/rare/")], "page_id long, url string")
    assert rule_index(pages, [Rule("/common/rare/", "block"), Rule("*", "block")], "url")[0][0] == "rare"
    assert rule_index(pages, [Rule("*x*", "block")], "url")[0][0] == ""


def test_warc(spark):
    long = "é<p>" * 60
    rows = [(5, "u5", long), (3, "u3", long), (3, "u3", long), (9, None, long), (None, "n", long), (1, "u1", None), (2, "a\r\nb %", ""), (4, "u4", "short"), (6, "u6", "short"),
            (7, "u7", "x" * 400_000), (8, "u8", "y" * 99), (10, "u10", "y" * 99), (11, "w", "WARC/1.1\r\n\r\n" * 20), (12, "r", "\x00\r\n\r\n" * 30)]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string")
    index = write_bundles(plan_records(pages), scratch_path(spark, "warc"), frame_bytes=2000, bundle_bytes=5000)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read_bundles(index).collect()), key=repr)
    want, seen = [], defaultdict(list)
    for i, u, h in rows:
        seen[h or ""].append((i is None, i or 0, u is None, u or "", i))
    done = set()
    for i, u, h in rows:
        data = (h or "").encode()
        head = min(seen[h or ""])
        new = len(data) < 100 or ((i is None, i or 0, u is None, u or "", i) == head and h not in done)
        done |= {h} if new else set()
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if new else "revisit", None if new else head[4]))
    assert got == sorted(want, key=repr)
    some = index.where("page_id IN ('7', '4', '12')")
    assert {(r.page_id, bytes(r.payload).decode()) for r in fetch_records(some).collect()} == {(7, "x" * 400_000), (4, "short"), (12, "\x00\r\n\r\n" * 30)}
    ids = [r.record_id for r in index.collect()]
    assert len(set(ids)) == len(ids) == len(rows)
    assert read_bundles(write_bundles(plan_records(pages.where("false")), scratch_path(spark, "warc"))).count() == 0


ITEM = "A train leaves Paris with 120 people and 35 kg of mail, then Maria counts 48 boxes before the train stops near the old harbour wall"


def test_templates(spark):
    changed = ITEM.replace("Paris", "Lyon").replace("120", "77").replace("35 kg", "12 lb").replace("Maria", "Elena").replace("48", "9")
    longer = ITEM.replace("Paris", "New York").replace("120", "77").replace("Maria", "Maria Elena").replace("48", "5")
    mixed = "before it all " + ITEM.replace("120", "77") + " and, again, " + ITEM.replace("120", "78")
    two = "first " + changed + " and then " + longer
    askew = ITEM.replace("leaves Paris with 120", "leaves Lyon with 77").replace("48 boxes", "48 boxes of 120")
    texts = ["words before " + ITEM + " and words after", changed, "a clean text about a train and some people near a wall " * 3, ITEM[: len(ITEM) // 4], ITEM.lower(), mixed, "12 34 56 78 90 " * 30,
             longer, two, "Who wrote: Hamlet?", "someone who wrote hamlet again and again", "5 6 7 8 9 10 11 12 13", "5 6 7 8 9 10 99 98 97", askew, "long " * 300 + "people Who wrote Hamlet. " + "more " * 300, "it said that 12 kg were left. And", "12 kg were left", "it said that 13 kg were left", "wrote hamlet who wrote it"]
    docs = odd_docs(spark, texts)
    items = spark.createDataFrame([(1, ITEM), (2, "who wrote Hamlet"), (3, None), (4, "5 6 7 8 9 10 11 12 13"), (None, "another question with enough words to be one at all"), (5, ""), (6, "12 kg were left"), (7, "wrote")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in contaminated(docs, items).collect()}
    assert set(got) == {(100, 1), (101, 1), (104, 1), (105, 1), (107, 1), (108, 1), (109, 2), (110, 2), (111, 4), (113, 1), (114, 2)} | {(115, 6), (116, 6)}
    assert {k for k, r in got.items() if r.reparameterised} == {(101, 1), (107, 1), (108, 1)}
    kept = without_contaminated(docs, items)
    assert kept.count() == docs.count() - len({d for d, _ in got}) and kept.columns == docs.columns
    assert contaminated(no_docs(spark), items).count() == 0 and contaminated(docs, items.where("false")).count() == 0
    merged = contaminated(docs, items, broadcast_rows=0)
    assert {(r.doc_id, r.item_id) for r in merged.collect()} == set(got)


# A brute-force version: the same windows and occurrences, told by plain loops.
SPLIT = re.compile("[\x00\x01\x05\x07-/:-@\\[-`{-\x7f\u00a0-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u2000-\u206f\u3000-\u303f]+")


def brute_windows(text):
    words, tokens = [w for w in (text or "").split(" ") if w], []
    for i, w in enumerate(words):
        before = words[i - 1] if i else ""
        name = w[:1].isupper() and w[1:2].islower()
        kind = None
        if name and i and (before[-1].islower() or before[-1] in ",;"):
            kind = "name"
            if tokens and tokens[-1][1] == "name" and before[-1].islower() and before[:1].isupper():
                tokens[-1] = (tokens[-1][0] + " " + SPLIT.sub("", w.lower()), "name")
                continue
        if w.lower().strip(",.;?") in UNITS and before[-1:].isdigit():
            kind = "unit"
        w = re.sub("(?<=[0-9])[.,](?=[0-9])", "\x04", w)
        tokens += [(x, kind or ("number" if x[0].isdigit() else None)) for x in SPLIT.split(w.lower()) if x]
    out = []
    for i in range(max(1, len(tokens) - 4) if tokens else 0):
        part = tokens[i : i + 5]
        values = [(x, k) for x, k in part if k]
        if values and len(values) <= 2:
            out.append((i, tuple(k and f"<{k}>" or x for x, k in part), tuple(x for x, _ in values)))
        else:
            out.append((i, ("verbatim", *part), None))
    return out


def brute_contaminated(docs, items):
    found = set()
    for d, text in docs:
        windows = defaultdict(list)
        for i, h, v in brute_windows(text):
            windows[h].append((i, v))
        for item, whole in items:
            for form in {whole, whole.lower()}:
                exact, at, counted = set(), defaultdict(lambda: defaultdict(set)), set()
                mine = brute_windows(form)
                for i, h, own in mine:
                    for j, v in windows.get(h, ()):
                        if v == own:
                            exact.add(h)
                        for a, b in zip(own or (), v or (), strict=True):
                            at[j - i][a].add(b)
                for i, h, own in mine:
                    for j, v in windows.get(h, ()):
                        if own and all(len(b) == 1 for b in at[j - i].values()):
                            counted.add(h)
                if len(exact | counted) >= 0.5 * len({h for _, h, _ in mine}):
                    found.add((d, item))
    return found


def test_templates_equal_a_brute_force_version(spark):
    rng = random.Random(11)
    names = [a + b for a in ("Par", "Mar", "Osl", "Rom", "Len", "Tor", "Bel", "Kan") for b in ("is", "ia", "o", "en", "ark York", "a Sund")]
    plain = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    plain = [w.replace("w", "q") for w in plain]

    def value(kind):
        return rng.choice(names) if kind == "N" else str(rng.randint(2, 999)) + (rng.choice([" kg", " miles", ""]) if kind == "U" else "")

    templates = [[rng.choice(["N", "D", "U"]) if rng.random() < 0.17 else rng.choice(plain) for _ in range(rng.randint(6, 25))] for _ in range(25)]
    fill = lambda t, known: " ".join(known.setdefault((i, w), value(w)) if len(w) == 1 else w for i, w in enumerate(t))
    items = [(i, "so " + fill(t, {})) for i, t in enumerate(templates)]
    texts = []
    for i, t in enumerate(templates):
        noise = lambda n: " ".join(rng.choice(plain) for _ in range(n))
        once, again = fill(t, {}), fill(t, {})
        texts += [items[i][1], f"{noise(5)} {once} {noise(3)}", f"{noise(2)} {once} {noise(4)} {again}", f"{once} and {items[i][1]}", noise(40)]
        words = once.split(" ")
        texts.append(" ".join(words[: len(words) // 2] + [noise(1)] + words[len(words) // 2 :]))
        texts.append(" ".join(w if rng.random() < 0.8 else value("D") for w in words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_contaminated(list(enumerate(texts)), items)
    assert got == want
    assert sum((7 * i + k, i) in got for i in range(25) for k in (0, 1, 2, 3)) >= 95


def test_decontamination_finds_planted_items(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    norm = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    texts = [(r.item_id, norm(r.text)) for r in items.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in texts if t and t in norm(r.text)}
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, items).select("doc_id", F.col("item_id")).collect()}
    assert want <= got


def test_a_long_run_of_names_is_one_name(spark):
    """A pattern that recurses for each word of a run overflows the stack of a task, which ends the executor."""
    item = "so qab qac qad qae qaf qag qah qai qaj"
    texts = [f"{item} in {'Paris Rome ' * 20_000}qba qbb", f"qbc in {'Paris Rome ' * 20_000}qba {item[3:]}", f"qba in {'Paris Rome ' * 20_000}qbb"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert got == {(0, 7), (1, 7)}
