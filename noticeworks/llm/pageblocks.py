"""Leaf blocks of a page in order, each with its tag path; and pages with known main text, made to train on."""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator

#: Comments, elements without readable text, declarations, tags; a quoted value may hold `>`.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|textarea|title|svg|object)\b(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>",
    re.S | re.I,
)
ATTR = re.compile(r"\b(class|id|role|style|hidden|aria-label)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: What an opening tag ends, if it is still open inside of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
PATH_BUCKETS = 4096


def _bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % PATH_BUCKETS


def element(tag: str, attrs: str) -> tuple[int, ...]:
    """Buckets of a tag: its name, and the names in its class, id and role, whole and in parts; whether it is hidden."""
    out = {"t:" + tag}
    for name, *values in ATTR.findall(attrs):
        value = "".join(values)
        if name.lower() == "hidden" or name.lower() == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            out.add("hidden")
        elif name.lower() != "style":
            for word in value.split():
                out.add("c:" + word.lower())
                out.update("c:" + p.lower() for p in PART.findall(word))
    return tuple(sorted({_bucket(t) for t in out}))


class Reader:
    """Cuts pages into blocks; tags and paths that were seen before are not read again."""

    def __init__(self) -> None:
        self.elements: dict[tuple[str, str], tuple[int, ...]] = {}
        self.paths: dict[tuple, int] = {}

    def blocks(self, page: str) -> list[tuple[str, int, float]]:
        """(text, path number, share of its characters in links) of each block that has text.

        A block is the text between two tags that are not inline; white space is one space, references are decoded.
        Tags that are left open end with what holds them.
        """
        out: list[tuple[str, int, float]] = []
        stack: list[tuple[str, tuple[int, ...]]] = []
        held: list[tuple[str, bool]] = []
        links = 0

        def flush() -> None:
            if held:
                text = " ".join(html.unescape("".join(t for t, _ in held)).split())
                if text:
                    path = tuple(ids for _, ids in stack)
                    linked = sum(len(t) for t, a in held if a)
                    out.append((text, self.paths.setdefault(path, len(self.paths)), linked / max(1, sum(len(t) for t, _ in held))))
                held.clear()

        def pop(at: int) -> None:
            nonlocal links
            links -= sum(t == "a" for t, _ in stack[at:])
            del stack[at:]

        last = 0
        for m in TOKEN.finditer(page):
            if m.start() > last:
                held.append((page[last : m.start()], links > 0))
            last = m.end()
            if m[3] is None:
                continue
            tag = m[3].lower()
            if m[2]:
                if tag not in INLINE:
                    flush()
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        pop(i)
                        break
                continue
            if tag == "br":
                held.append((" ", False))
                continue
            if tag not in INLINE:
                flush()
                if tag in ENDS:
                    ends, inside = ENDS[tag]
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] in inside:
                            break
                        if stack[i][0] in ends:
                            pop(i)
                            break
                elif tag not in VOID:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == "p":
                            pop(i)
                            break
                        if stack[i][0] not in INLINE:
                            break
            if tag not in VOID and not m[4].endswith("/"):
                key = (tag, m[4])
                if key not in self.elements:
                    if len(self.elements) > 50_000:
                        self.elements.clear()
                    self.elements[key] = element(tag, m[4])
                stack.append((tag, self.elements[key]))
                links += tag == "a"
        if last < len(page):
            held.append((page[last:], links > 0))
        flush()
        return out


#: Names that pages give to parts of theirs; fixed values.
MAIN_NAMES = "content main-content article post entry entry-content post-content article-body story story-body body-text text page-content single article__body".split()
MENU_NAMES = "menu nav navbar navigation topnav main-menu site-nav breadcrumb breadcrumbs tabs pagination links".split()
HEADER_NAMES = "header site-header masthead top banner-top page-header branding logo".split()
FOOTER_NAMES = "footer site-footer bottom copyright colophon page-footer legal imprint".split()
SIDE_NAMES = "sidebar side aside widget widgets related recommended popular trending more-stories rail right-col secondary teaser".split()
NOTICE_NAMES = "notice cookie cookie-notice cookie-banner consent gdpr alert message popup modal overlay notification paywall toast announcement".split()
ADVERT_NAMES = "ad ads advert advertisement sponsor sponsored promo promotion banner adsbygoogle ad-slot commercial".split()
FORM_NAMES = "search subscribe newsletter login signup contact-form form subscription".split()
COMMENT_NAMES = "comments comment comment-list commentlist responses respond discussion replies reader-comments disqus comment-body user-comments".split()
SHARE_NAMES = "share social sharing share-buttons follow tags meta".split()
PLAIN_WORDS = {
    "menu": "home about contact news sport products services archive help login",
    "notice": "we use cookies to improve your experience accept privacy policy settings agree",
    "ad": "buy now sale offer discount sponsored free shipping best price click here",
    "form": "subscribe to our newsletter enter your email search submit send name password",
    "comment": "reply says posted by ago thanks great post I agree comment report",
    "side": "related stories read more popular trending latest see also recommended",
    "footer": "copyright all rights reserved terms privacy imprint contact about powered by",
    "share": "share tweet like follow us facebook email print tags",
}
SOME = "the of and to in a is it der die und das en la de que el los le et les un une par com på och er det".split()
#: Label characters of the made pages, taken off before anything is measured.
YES, NO = "\ue000", "\ue001"


def made_page(r: random.Random) -> str:
    """A page whose texts begin with YES (main text) or NO."""
    pick = lambda seq: seq[r.randrange(len(seq))]
    syllables = ["".join(pick("aeiouäéöbcdfghklmnprstvw") for _ in range(r.randrange(1, 4))) for _ in range(40)]
    noise = r.random() < 0.25

    def word() -> str:
        w = pick(SOME) if r.random() < 0.35 else "".join(pick(syllables) for _ in range(r.randrange(1, 4)))
        return w + pick(["###", "***", "&amp;&amp;", "$$$", ",", "%%%"]) if noise and r.random() < 0.6 else w

    def words(n: int, kind: str = "", share: float = 0.0) -> str:
        own = PLAIN_WORDS[kind].split() if kind else []
        if not kind and n > 3 and r.random() < 0.08:  # one or a few words again and again
            few = [word() for _ in range(r.randrange(1, 4))]
            return " ".join(few * n)
        out = [pick(own) if own and r.random() < share else word() for _ in range(n)]
        text = " ".join(out)
        return text[:1].upper() + text[1:] + pick([".", ".", "", "!", "?"])

    def length(short: bool) -> int:
        return r.randrange(1, 7) if short else int(min(220, 4 + r.expovariate(1 / 35)))

    def inline(text: str) -> str:
        if r.random() < 0.25 and " " in text:
            a, _, b = text.partition(" ")
            t = pick(["b", "em", "a href='/x'", "strong", "span class=hl", "i"])
            return f"{a} <{t}>{b}" + ("" if r.random() < 0.2 else f"</{t.split()[0]}>")
        return text

    opaque = r.random() < 0.12  # names say nothing

    def box(inner: str, names: list[str], tags: list[str]) -> str:
        tag = pick(tags)
        name = "".join(pick("abcdefghijkmnopqrstuvxyz0123456789") for _ in range(6)) if opaque and tag not in ("article", "main", "nav", "footer", "header", "aside", "form") else pick(names)
        if tag in ("article", "main", "nav", "footer", "header", "aside", "form") and r.random() < 0.6:
            at = ""
        else:
            at = f' {pick(["class", "class", "id"])}="{name + pick(["", "", " box", " col-8", " wrap"])}"'
        return f"<{tag}{at}>{inner}</{tag}>"

    def items(kind: str, n: int, mark: str = NO) -> str:
        one = lambda: f'<li><a href="/{word()}">{mark}{words(r.randrange(1, 4), kind, 0.4)}</a></li>'
        return f"<ul>{''.join(one() for _ in range(n))}</ul>"

    def texts(kind: str, mark: str = NO) -> str:
        say = lambda: mark + inline(words(length(r.random() < 0.4), kind, float(r.random()) * 0.6))
        shape = r.randrange(4)
        if shape == 0:
            return say()
        if shape == 1:
            return "".join(f"<p>{say()}</p>" for _ in range(r.randrange(1, 4)))
        if shape == 2:
            return f"<h3>{mark}{words(3, kind, 0.5)}</h3><p>{say()}</p>"
        return f"<div>{say()}</div>" + (items(kind, 3) if r.random() < 0.4 else "")

    def form() -> str:
        return box(f"<label>{NO}{words(2, 'form', 0.7)}</label><input type=text name=q><button>{NO}{words(1, 'form', 0.8)}</button>" + (f"<p>{NO}{words(12, 'form', 0.5)}</p>" if r.random() < 0.4 else ""), FORM_NAMES, ["form", "form", "div"])

    def menu() -> str:
        return box(items("menu", r.randrange(3, 12)), MENU_NAMES, ["nav", "nav", "div", "ul"])

    def advert() -> str:
        return box(texts("ad"), ADVERT_NAMES, ["div", "div", "aside", "section"])

    def notice() -> str:
        return box(texts("notice") + (f"<button>{NO}{words(1, 'notice', 0.8)}</button>" if r.random() < 0.4 else ""), NOTICE_NAMES, ["div", "div", "section", "aside"])

    def side() -> str:
        return box("".join(box(texts("side") + (items("side", 4) if r.random() < 0.6 else ""), SIDE_NAMES, ["div", "section"]) for _ in range(r.randrange(1, 4))), SIDE_NAMES, ["aside", "div", "div"])

    def comments() -> str:
        one = lambda: box((f"<cite>{NO}{words(2)}</cite>" if r.random() < 0.5 else "") + texts("comment"), COMMENT_NAMES, ["div", "li", "article", "section"])
        head = f"<h3>{NO}{words(2, 'comment', 0.8)}</h3>" if r.random() < 0.6 else ""
        return box(head + "".join(one() for _ in range(r.randrange(1, 7))) + (form() if r.random() < 0.3 else ""), COMMENT_NAMES, ["div", "section", "ol", "div"])

    def share() -> str:
        return box(items("share", 3) if r.random() < 0.5 else NO + words(3, "share", 0.7), SHARE_NAMES, ["div", "ul"])

    def footer() -> str:
        return box(NO + "&copy; " + words(length(r.random() < 0.5), "footer", 0.4) + (items("footer", 4) if r.random() < 0.4 else ""), FOOTER_NAMES, ["footer", "footer", "div"])

    def header() -> str:
        return box((f"<h1>{NO}{words(2)}</h1>" if r.random() < 0.3 else NO + words(2)) + (menu() if r.random() < 0.5 else "") + (form() if r.random() < 0.3 else ""), HEADER_NAMES, ["header", "header", "div"])

    def main() -> str:
        title = f"<h1>{YES}{words(r.randrange(1, 9))}</h1>"
        parts = [f"<header>{title}</header>" if r.random() < 0.15 else title] if r.random() < 0.9 else []
        for _ in range(int(1 + r.expovariate(1 / 5))):
            shape = r.random()
            if shape < 0.72:
                stray = pick(["", "", "", "footer", "comment", "notice", "menu", "ad", "side"])
                p = "<p>" + YES + inline(words(length(r.random() < 0.25), stray, 0.15))
                parts.append(p + pick(["</p>", "</p>", "</p>", "<br>", ""]))
            elif shape < 0.80:
                parts.append(f"<h2>{YES}{words(r.randrange(1, 6))}</h2>")
            elif shape < 0.85:
                parts.append("<ul>" + "".join(f"<li>{YES}{inline(words(length(True)))}</li>" for _ in range(r.randrange(2, 6))) + "</ul>")
            elif shape < 0.89:
                parts.append(f"<blockquote>{YES}{words(length(False))}</blockquote>")
            elif shape < 0.92:
                parts.append("<table>" + "".join("<tr>" + "".join(f"<td>{YES}{words(2)}</td>" for _ in range(2)) + "</tr>" for _ in range(3)) + "</table>")
            elif shape < 0.95:
                parts.append(f"<figure><img src=x alt=y><figcaption>{YES}{words(6)}</figcaption></figure>")
            else:
                parts.append(f"<div>{YES}{words(length(False))}</div>")
            if r.random() < 0.06:
                parts.extend(parts[-1:] * r.randrange(1, 8))
            if r.random() < 0.09:
                parts.append(pick([advert, advert, share, side, form, notice])())
        if r.random() < 0.12:
            parts.append(share())
        if r.random() < 0.12:
            parts.append(comments())
        if r.random() < 0.08:
            parts.append(footer())
        return box("".join(parts), MAIN_NAMES, ["article", "article", "article", "main", "div", "div", "section", "td"])

    maybe = lambda f, p: f() if r.random() < p else ""
    before = [maybe(notice, 0.25), maybe(header, 0.4), maybe(menu, 0.6), maybe(advert, 0.4), maybe(side, 0.12), maybe(form, 0.1)]
    after = [maybe(advert, 0.2), maybe(side, 0.3), maybe(comments, 0.3), maybe(form, 0.15), maybe(share, 0.1), maybe(notice, 0.12), maybe(menu, 0.1), maybe(footer, 0.7)]
    r.shuffle(before)
    body = "".join(before) + (main() if r.random() < 0.97 else "") + "".join(after)
    if r.random() < 0.3:
        body = f'<div class="{pick(["wrapper", "container", "page", "site", "x1", "layout row"])}">{body}</div>'
    return f"<!DOCTYPE html><html><head><title>{words(4)}</title><style>p{{margin:0}}</style></head><body>{body}<script>var a='<p>';</script></body></html>"


def made_pages(n: int, seed: int) -> Iterator[str]:
    """`n` made pages, the same for the same seed."""
    r = random.Random(seed)
    for _ in range(n):
        yield made_page(r)
