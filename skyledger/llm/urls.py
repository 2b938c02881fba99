"""URL filter: rules by host and path, else logistic regression on hashed character n-grams."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import Memo, over_batches

DIM = 1 << 13
GRAMS = (3, 4, 5)

# The small labelled table: invented hosts and paths of reserved domains, 1 for block.
BLOCK_HOSTS = """casino-gold lucky-casino mega-casino casino-bonus poker-stars-play online-poker
slots-jackpot free-slots best-bets sport-bets betting-tips bet-now adult-video adult-chat adult-zone xxx-tube
sexy-chat hot-singles porn-free escort-city pills-online buy-viagra cheap-meds pharma-discount
diet-pills spam-links link-farm seo-farm ad-tracker track-clicks click-ads popup-ads
banner-ads payday-loans quick-loan win-prize free-prize lottery-winner replica-watches warez-crack
torrent-crack keygen-free phishing-login malware-drop""".split()
ALLOW_HOSTS = """news weather city-news daily-post library museum university school physics chemistry maths
garden cooking recipes kitchen travel trains airport harbour mountain river history archive science nature
open-source code docs developer python database research journal papers health-service hospital doctor
parliament council government justice music concert theatre film books reading poetry art gallery design
football-club athletics chess cycling rowing language grammar dictionary encyclopedia wiki forum community
market bakery bookshop furniture hotel restaurant cinema bank insurance radio television magazine""".split()
PREFIXES = ("", "www.", "m.", "blog.")
DOMAINS = (".example.com", ".example.org", ".example.net", ".test")
BLOCK_PATHS = ("/", "/en/1", "/de/win", "/fr/275.html", "/es/41/", "/bonus/free")
ALLOW_PATHS = ("/", "/en/1", "/de/news", "/fr/275.html", "/es/41/", "/about/team")
# Syllables of hosts that mean nothing: an unknown name is no reason to block.
SYLLABLES = "th er on an re he in ed nd ha at en es or nt ea ti to it st io le is ou ar as de rt ve".split()


def labelled_urls() -> list[tuple[str, str, int]]:
    """(host, path, block) for training, by rule from the fixed names."""
    rows = []
    for block, hosts, paths in ((1, BLOCK_HOSTS, BLOCK_PATHS), (0, ALLOW_HOSTS, ALLOW_PATHS)):
        for i, host in enumerate(hosts):
            for k in range(4):
                rows.append((PREFIXES[(i + k) % 4] + host + DOMAINS[k], paths[(i + k) % len(paths)], block))
    draw = np.random.default_rng(3)
    for i in range(200):
        host = "".join(draw.choice(SYLLABLES, draw.integers(2, 5)))
        rows.append((PREFIXES[i % 4] + host + DOMAINS[i % 3], ALLOW_PATHS[i % 6], 0))
    return rows


def features(kind: str, text: str) -> list[int]:
    """Buckets of the distinct character n-grams of a host or a path."""
    padded = f"^{text}$"
    grams = {padded[k : k + n] for n in GRAMS for k in range(max(len(padded) - n + 1, 0))}
    return sorted({xxhash.xxh3_64_intdigest(kind + g) % DIM for g in grams})


def train(steps: int = 600, rate: float = 2.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient descent with momentum on the labelled table."""
    rows = labelled_urls()
    x = np.zeros((len(rows), DIM), dtype=np.float32)
    for i, (host, path, _) in enumerate(rows):
        at = features("h", host) + features("p", path)
        x[i, at] = 1 / np.sqrt(len(at))
    y = np.array([r[2] for r in rows], dtype=np.float32)
    w, speed = np.zeros(DIM, dtype=np.float32), np.zeros(DIM, dtype=np.float32)
    b, speed_b = 0.0, 0.0
    for _ in range(steps):
        error = (1 / (1 + np.exp(-(x @ w + np.float32(b)))) - y) / np.float32(len(y))
        speed = np.float32(0.9) * speed - np.float32(rate) * (error @ x + np.float32(decay) * w)
        speed_b = 0.9 * speed_b - rate * float(error.sum())
        w, b = w + speed, b + speed_b
    return w, float(b)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host between the first :// and / ? # or the end, A-Z lowered; path from there to ? # or the end.

    Both are empty for null or without ://.
    """
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    host = F.translate(
        F.regexp_extract(text, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    return host, F.regexp_extract(text, pattern, 2)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does.

    Rules are (verdict, host/path). A rule fits its host and all subdomains where the path starts with
    the rule's path.
    """
    rule = verdict = None
    for what, text in sorted(rules, key=lambda r: -len(r[1])):
        name, _, begin = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + begin)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def _judge(weights: np.ndarray, bias: float):
    def build():
        def part(key: tuple[str, str]) -> tuple[float, int]:
            at = features(*key)
            return float(weights[at].sum()), len(at)

        memo = Memo(part, 100_000)

        def work(batch: pa.RecordBatch) -> list:
            out = []
            for host, path in zip(
                batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True
            ):
                (a, n), (b, m) = memo["h", host], memo["p", path]
                out.append(1 / (1 + np.exp(-((a + b) / np.sqrt(max(n + m, 1)) + bias))))
            return [*(batch.column(c) for c in ("page_id", "host", "path", "rule", "ruled")), out]

        return work

    return build


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], block_from: float = 0.5) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score.

    ``verdict`` is that of the longest rule, or else "block" where the model gives ``block_from`` or
    more. A url without host and path is judged like any other, on its empty text. Repeated rows stay.
    """
    weights, bias = train()
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, ruled = longest_rule(F.col("host"), F.col("path"), rules)
    scored = over_batches(
        rows.withColumn("rule", rule).withColumn("ruled", ruled),
        _judge(weights.astype(np.float64), bias),
        "page_id long, host string, path string, rule string, ruled string, score double",
    )
    guess = F.when(F.col("score") >= block_from, "block").otherwise("allow")
    return scored.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", guess).alias("verdict"), "score"
    )
