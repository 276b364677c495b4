"""URL filters: all glob rules run at once as one bit-parallel automaton over each canonical URL.

Every glob becomes a run of bits, one for its start and one for each character that it consumes. A '*' gives the bit
before it a self-loop. The runs lie one after the other in as many 64-bit words as they need, so a step of the automaton
is a shift, an AND with the mask of the character and an OR with the looping bits, for all rules and a whole batch of URLs
together (Shift-And).

Cases: a null URL or one without '://' has an empty host and path, fits no rule and gets the verdict for URLs without a
host; repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ends the host in a canonical URL; it cannot occur in one, as "\0" in a path is percent-encoded first.
MARK = "\0"


@dataclass(frozen=True)
class Rule:
    """glob: over the canonical URL ('.' + host + MARK + path); name: what is reported; rank: the higher one wins."""

    glob: str
    action: str
    name: str
    rank: int


def prefix_rule(action: str, rule: str) -> Rule:
    """A rule such as 'example.com/en/' for a host, its subdomains and a prefix of the path. The longest one wins."""
    host, slash, path = rule.partition("/")
    return Rule(f"*.{host.lower()}{MARK}{slash}{path}*", action, rule, 1_000_000 + len(rule))


def glob_rule(action: str, glob: str) -> Rule:
    """A glob over 'host/path' in which '*' stands for any run of characters. It yields to any prefix rule."""
    host, slash, path = glob.partition("/")
    return Rule(f"*.{host.lower()}{MARK}{slash}{path}" if slash else f"*.{host.lower()}{MARK}*", action, glob, len(glob))


#: The listed rules.
LISTED = (
    prefix_rule("block", "com/en/"),
    prefix_rule("allow", "example.com/en/7"),
    prefix_rule("allow", "net/de/"),
    prefix_rule("block", "example.net/de/8"),
    prefix_rule("block", "org/es/"),
)
#: Globs for what no listed rule fits: hosts of advertising, counting and shortening, paths of machinery, files that are no pages.
GENERAL = tuple(
    glob_rule("block", g)
    for g in (
        "ads.*", "ad.*", "adserver.*", "adservice.*", "*.ads.*", "banner.*", "doubleclick.*", "analytics.*", "tracker.*", "tracking.*", "pixel.*", "metrics.*", "telemetry.*", "popup.*", "casino*.*", "sex*.*", "bit.ly", "t.co", "tinyurl.com",
        "*/ads/*", "*/adframe*", "*/banners/*", "*/cgi-bin/*", "*/wp-admin/*", "*/wp-login*", "*/wp-json/*", "*/xmlrpc.php", "*/login*", "*/signin*", "*/logout*", "*/cart/*", "*/checkout/*", "*/admin/*", "*/phpmyadmin/*", "*/.git/*", "*/.env*", "*/search/*", "*/track/*", "*/pixel.gif",
        "*/*.exe", "*/*.msi", "*/*.dmg", "*/*.zip", "*/*.rar", "*/*.7z", "*/*.gz", "*/*.apk", "*/*.iso", "*/*.torrent", "*/*.mp3", "*/*.mp4", "*/*.avi", "*/*.jpg", "*/*.png", "*/*.gif", "*/*.css", "*/*.js",
    )
)


class ShiftAnd:
    """The automaton of some globs. '*' is the only wildcard."""

    def __init__(self, globs: list[str]):
        start, loop, final, chars, n = [], [], [], [], 0
        for g in globs:
            first = n
            start.append(n)
            n += 1
            for b in g.encode():
                if b == ord("*"):
                    loop.append(n - 1)
                else:
                    chars.append((b, n))
                    n += 1
            final.append(n - 1)
            assert n > first
        self.words = max(1, -(-n // 64))
        self.start, self.loop = self._mask(start), self._mask(loop)
        self.step = np.zeros((256, self.words), np.uint64)
        for b, bit in chars:
            self.step[b, bit // 64] |= np.uint64(1 << bit % 64)
        self.final = np.array(final, np.int64)

    def _mask(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for b in bits:
            out[b // 64] |= np.uint64(1 << b % 64)
        return out

    def match(self, texts: list[bytes]) -> np.ndarray:
        """Booleans by text and glob. Texts are run in order of length, so that short ones do not wait for long ones."""
        n = len(texts)
        lengths = np.fromiter(map(len, texts), np.int64, n)
        order = np.argsort(-lengths, kind="stable")
        flat = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
        begin = (np.cumsum(lengths) - lengths)[order]
        left = lengths[order]
        d = np.repeat(self.start[None, :], n, axis=0)
        one, top = np.uint64(1), np.uint64(63)
        alive = n
        for at in range(int(lengths.max()) if n else 0):
            while alive and left[alive - 1] <= at:
                alive -= 1
            now = d[:alive]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            d[:alive] = (moved & self.step[flat[begin[:alive] + at]]) | (now & self.loop)
        hit = (d[:, self.final // 64] >> (self.final % 64).astype(np.uint64)) & one
        out = np.empty(hit.shape, bool)
        out[order] = hit.astype(bool)
        return out


def host_and_path(url):
    """Columns (host, path) of a URL column: after the first '://', the host up to '/', '?', '#' or the end with A-Z lower-cased, then the path up to '?', '#' or the end."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substr(text, at + F.lit(3))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge_urls(df: DataFrame, rules: tuple[Rule, ...], id_col: str = "page_id", url_col: str = "url", default: str = "allow", no_host: str = "block") -> DataFrame:
    """id, host, path, winning rule (name, action; null if none fits) and verdict of each row. Narrow, no shuffle."""
    host, path = host_and_path(F.col(url_col))
    parts = df.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    kind = parts.schema["id"].dataType.simpleString()
    by_rank = sorted(rules, key=lambda r: (-r.rank, r.name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ShiftAnd([r.glob for r in by_rank])
        names = pa.array([r.name for r in by_rank], pa.string())
        actions = pa.array([r.action for r in by_rank], pa.string())
        for batch in batches:
            hosts, paths = batch["host"].to_pylist(), batch["path"].to_pylist()
            texts = [f".{h.replace(MARK, '%00')}{MARK}{p.replace(MARK, '%00')}".encode() for h, p in zip(hosts, paths)]
            known = {t: i for i, t in enumerate(dict.fromkeys(texts))}
            hit = automaton.match(list(known))
            best = np.where(hit.any(1), hit.argmax(1), -1)[[known[t] for t in texts]] if texts else np.empty(0, np.int64)
            at = pa.array(best, pa.int64(), mask=best < 0)
            action = actions.take(at).to_pylist()
            verdict = [a or (no_host if not h else default) for a, h in zip(action, hosts)]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["host"], batch["path"], names.take(at), pa.array(verdict, pa.string())], ["id", "host", "path", "rule", "verdict"])

    return parts.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string")
