"""What can be said about the end of a text: its last signs, its length, and how it stands to the page it was taken from."""

from __future__ import annotations

import html
import re
import zlib

DIMENSIONS = 1 << 14
TERMINAL = ".!?。！？…"
CLOSERS = ")]}\"”»’'』」"
#: Marks put where a text was cut (fixed values).
MARK = re.compile(r"\s*(\.\.\.|…|\[…\]|\[\.\.\.\]|\(\.\.\.\)|\[cut\]|\[truncated\])\s*$", re.I)
#: Charsets in which a page is tried when its text does not show in the one before.
CHARSETS = ("utf-8", "cp1252", "latin-1", "cp1251", "shift_jis", "koi8_r", "euc_jp", "iso8859_15")
#: Tags that do not end a block of text.
INLINE = ("a", "b", "i", "em", "strong", "span", "small", "u", "sub", "sup", "code", "font")
_TAG = re.compile(r"<!--.*?-->|<(?:script|style|title)\b.*?</(?:script|style|title)\s*>|<(/?)([a-zA-Z!][\w!]*)[^<>]*>", re.S | re.I)
_TORN = re.compile(r"<[^<>]*$")
#: Left out when a text is looked for in its page: white space, signs and characters that were lost in a conversion.
_SIGNS = re.compile(r"[^\w\0]+")
_LENGTH = re.compile(r"^content-length:\s*(\d+)\s*$", re.I | re.M)
_PACKED = re.compile(r"^content-encoding:\s*\S", re.I | re.M)
_TAILS = (40, 16)


def without_mark(text: str) -> tuple[str, bool]:
    plain = MARK.sub("", text)
    return (plain, True) if plain != text.rstrip() and plain else (text.rstrip(), False)


def blocks(page: str) -> tuple[str, bool]:
    """(the letters and digits of the page's text with a NUL at each end of a block, torn).

    torn: the page stops within a tag or outside of any closing tag.
    """
    torn = bool(_TORN.search(page))
    page = _TORN.sub("", page)
    text = _TAG.sub(lambda m: "" if m[2] and m[2].lower() in INLINE else "\0", page)
    compact = _SIGNS.sub("", html.unescape(text))
    return compact, torn or not compact.endswith("\0")


def relation(text: str, body: bytes | None) -> str:
    """How the text's end stands to its page.

    none: there is no page. lost: the text's end is not in it. end: the page's text ends there as well, in a closed block;
    torn: it ends there because the page itself stops. block: the page goes on after the block that ends there. within: the
    page goes on within the same block.
    """
    if not body:
        return "none"
    plain, _ = without_mark(text)
    for charset in CHARSETS:
        page, torn = blocks(body.decode(charset, "replace"))
        flat = page.replace("\0", "")
        for shown in (plain, _TORN.sub("", plain)) if torn else (plain,):
            compact = _SIGNS.sub("", shown.replace("\0", ""))
            for n in _TAILS:
                tail = compact[-n:]
                if len(tail) < min(n, 6):
                    continue
                at = _nearest(flat, tail, len(compact) - len(tail))
                if at < 0:
                    continue
                left = len(flat) - at - len(tail)
                if not left:
                    return "torn" if torn else "end"
                return "block" if _closes(page, at + len(tail)) else "within"
    return "lost"


def _nearest(flat: str, tail: str, place: int) -> int:
    """Where tail is in flat, nearest to place if it is there more than once; -1 if it is not there."""
    before, after = flat.rfind(tail, 0, max(place, 0) + len(tail)), flat.find(tail, max(place, 0))
    if before < 0 or after < 0:
        return max(before, after)
    return before if place - before < after - place else after


def _closes(page: str, upto: int) -> bool:
    """Whether a block ends right after the first upto signs of page, NULs not counted."""
    seen, i = 0, 0
    while seen < upto:  # from NUL to NUL, so as many steps as there are blocks
        j = page.find("\0", i)
        j = len(page) if j < 0 else j
        if seen + j - i >= upto:
            i += upto - seen
            break
        seen += j - i
        i = j + 1
    return i >= len(page) or page[i] == "\0"


def sign(c: str) -> str:
    if not c:
        return "nothing"
    if c in TERMINAL:
        return "stop"
    if c in CLOSERS:
        return "closer"
    if c in ",;:-–—·/&(“«[{、，":
        return "open"
    if c == "�":
        return "broken"
    if c.isdigit():
        return "digit"
    if c.isalpha():
        return "wide" if ord(c) >= 0x2E80 else "upper" if c.isupper() else "lower"
    return "other"


def to_limit(limits: dict, source: str | None, *lengths: tuple[str, int]) -> str:
    """How near below one of its source's limits a length is: at, near, or far."""
    best = 99
    for kind, n in lengths:
        for limit in limits.get((source, kind), ()):
            if 0 <= limit - n < best:
                best = limit - n
    return "at" if best == 0 else "near" if best <= 3 else "by" if best <= 14 else "far"


def announced(headers: str | None, text: str, body: bytes | None) -> str:
    """What the response's head said about its length, against what is there."""
    found = _LENGTH.search(headers or "")
    if not found or _PACKED.search(headers or ""):
        return "unsaid"
    said = int(found[1])
    if body:
        return "as said" if said == len(body) else "less" if len(body) < said else "more"
    over = said - len(text.encode("utf-8", "replace"))
    return f"over {min(max(over, -1) // 100, 12)}"


def shape(line: str) -> str:
    """A short line with its figures and, after its first word, its names masked, so that headings of one form are alike."""
    if len(line) > 60:
        return "long"
    words = re.sub(r"\d+", "0", line).split()
    return " ".join(w if i == 0 or not w[:1].isupper() else "X" for i, w in enumerate(words)) if len(words) > 1 else re.sub(r"[A-Za-z]{2,}", "X", line)


def features(text: str, body: bytes | None, headers: str | None, source: str | None, limits: dict) -> list[int]:
    """The hashed features of one text; every text has as many."""
    plain, marked = without_mark(text)
    line = plain.rsplit("\n", 1)[-1]
    last = sign(plain[-1:])
    words = line.split()
    rel = relation(text, body)
    full = last == "stop" or (last == "closer" and any(c in TERMINAL for c in plain[-3:]))
    sentences = sum(line.count(c) for c in (". ", "! ", "? ", "。", "… "))
    kind = "listed" if "·" in line or " / " in line or "ﾂｷ" in line or " � " in line else "prose" if sentences or len(line) > 70 else "long" if len(words) > 5 or len(line) > 30 else "short"
    size = text.encode("utf-8", "replace")
    limit = to_limit(limits, source, ("chars", len(text)), ("bytes", len(size)), ("chars", len(plain)), ("bytes", len(plain.encode("utf-8", "replace"))))
    said = announced(headers, text, body)
    unclosed = any(line.count(a) > line.count(b) for a, b in ("()", "[]", "“”", "«»"))
    lower_start = bool(words) and words[0][:1].islower()
    figure = bool(words) and any(c.isdigit() for c in words[-1])
    rest = f"{kind}:{full}"
    near = "limit" if limit in ("at", "near") else "by" if limit == "by" else "far"
    no_page = rel in ("none", "lost")
    named = [
        "bias", f"rel {rel}", f"rel {rel}:{full}", f"rel {rel}:{kind}:{full}", f"rel {rel}:{last}", f"mark {marked}:{rel}", f"mark {marked}:{near}:{no_page}", f"mark {marked}:{said}:{no_page}",
        f"limit {limit}:{full}", f"limit {near}:{kind}:{full}:{no_page}", f"limit {near}:{marked}:{no_page}", f"last {last}:{kind}:{no_page}", f"size {min(len(words), 12)}:{full}:{no_page}",
        f"said {said}:{full}", f"said {said}:{rel}:{full}", f"unclosed {unclosed}:{full}", f"sentences {min(sentences, 3)}:{full}:{no_page}", f"lower {lower_start}:{rest}:{no_page}",
        f"figure {figure}:{rest}", f"line {min(len(line) // 30, 6)}:{full}:{no_page}", f"rest {rest}:{said if no_page else ''}", f"tag {'<' in plain[-12:]}:{no_page}", f"one {plain[-1:]}", f"shape {shape(line)}",
    ]
    return [zlib.crc32(n.encode("utf-8", "replace")) % DIMENSIONS for n in named]
