"""HTML operators: cleaning, structure, links, tables, images, rules, chunks. Each page is parsed in one Arrow pass."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .dom import Node, matches, parse, select

# What counts as noise and where content is looked for.
NOISE = ("nav", "header", "footer", ".navigation", ".nav", ".menu", ".breadcrumb", ".breadcrumbs", ".sidebar", ".side-bar", ".widget", ".related-links", ".quick-links", ".ads", ".advertisement", ".promo", ".banner", ".promotion", ".cookie-notice", ".cookie-banner", ".privacy-notice", ".gdpr-notice", ".social-share", ".share-buttons", ".social-media", ".follow-us", ".comments", ".feedback", ".rating", ".reviews", "script", "style", "noscript", '[style*="display:none"]', '[style*="visibility:hidden"]', ".hidden", ".sr-only", ".ministry-logo", ".gov-logo", ".contact-info", ".office-hours", ".last-updated", ".page-info")
CONTAINERS = (".content", ".main-content", ".page-content", ".article-content", ".policy-content", ".document-content", ".content-wrapper", ".main-wrapper", ".page-wrapper", "main", "article", '[role="main"]', ".container .row .col", "body")
BOILERPLATE = (".header", ".top-bar", ".utility-nav", ".footer", ".bottom-bar", ".site-info", ".skip-links", ".accessibility-links", ".search-form", ".site-search", ".language-selector", ".lang-switch", ".print-page", ".share-page", ".back-to-top", ".scroll-to-top")
PREFERRED = (".policy-content", ".document-content", ".article-content", ".main-content", ".content-wrapper", ".page-content", "main", "article", '[role="main"]', ".content", ".container .content", ".wrapper .content", "body")
PAGINATION = ('a[href*="page"]', 'a[href*="halaman"]', ".pagination a", ".pager a", "a:contains(Next)", "a:contains(Seterusnya)", "a:contains(>)", 'a[rel="next"]')
TITLE_LINE = r"^(TITLE|TAJUK|BAHAGIAN|SECTION)\s*:?\s*(.+)"
SECTION_LINE = r"^(\d+\.?\s*|[A-Z]\.?\s*|SECTION\s+\d+|BAHAGIAN\s+\d+)\s*(.+)"
SUBSECTION_LINE = r"^(\d+\.\d+\.?\s*|[a-z]\)?\s*|\([a-z]\)\s*)\s*(.+)"
BULLET = r"^(\*|\-|\•|[a-z]\)|\([a-z]\)|\d+\))\s*(.+)"
TOPIC_LINES = (r"^(ELIGIBILITY|KELAYAKAN|WHO CAN APPLY|SYARAT)", r"^(REQUIREMENTS|KEPERLUAN|DOCUMENTS REQUIRED|DOKUMEN)", r"^(PROCESS|PROSES|HOW TO APPLY|CARA MEMOHON)", r"^(BENEFITS|FAEDAH|WHAT YOU GET|MANFAAT)", r"^(CONTACT|HUBUNGI|ENQUIRY|PERTANYAAN)")
RULES = (("eligibility", ("eligibility", "kelayakan", "syarat")), ("required_documents", ("document", "dokumen", "required")), ("benefits", ("benefit", "manfaat", "faedah")))
CONTENT_NAMES, NOISE_NAMES = "content|article|main|body|post|entry", "nav|menu|sidebar|footer|header|ad|comment|widget"
MIN_CONTENT = 100
SKIPPED = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".pdf", ".zip", ".css", ".js", ".xml", ".json")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
MAX_TOKENS, MIN_TOKENS, OVERLAP = 600, 200, 100


def squeeze(s: str) -> str:
    return re.sub(r"\s+", " ", s).strip()


def score_text(s: str, least: int = 100) -> float:
    if len(s) < least:
        return 0.0
    words = re.split(r"\s+", s.lower())
    low = s.lower()
    return min(len(s) / 100, 100) + 2 * sum(len(x.strip()) > 10 for x in re.split("[.!?]+", s)) + 50 * len(set(words)) / len(words) + 5 * sum(k in low for k in tx.GOV_KEYWORDS)


def _matching(root: Node, selectors: tuple[str, ...]) -> set[int]:
    """Nodes that match a simple selector, each looked up by its tag and classes."""
    tags, classes = ({x.lstrip(".") for x in selectors if x.startswith(".") == dotted and not x.startswith("[")} for dotted in (False, True))
    others = [x for x in selectors if x.startswith("[")]
    return {id(n) for n in root.walk() if n.tag in tags or not classes.isdisjoint(n.classes()) or (n.attrs and any(matches(n, x) for x in others))}


def _element_score(node: Node, s: str, skip: frozenset[int]) -> float:
    score = min(len(s) / 100, 50) + 2 * len(node.find("p", skip=skip)) - 5 * len(node.find("a", skip=skip)) / max(len(s) / 100, 1)
    names = node.attrs.get("class", "") + node.attrs.get("id", "")
    score += 10 * bool(re.search(CONTENT_NAMES, names, re.I)) - 10 * bool(re.search(NOISE_NAMES, names, re.I))
    return max(0.0, score)


def _title(root: Node) -> str:
    return "".join(n.text() for n in root.find("title")) or next((n.text() for n in root.find("h1")), "")


def clean(html: str) -> tuple[str, str, float, str, str, int]:
    """(text, title, score, method, language, elements removed): the best of three strategies, the first of equals,
    else the body. A page that names no language is English, or Malay by the third strategy."""
    root = parse(html)
    noise = frozenset(_matching(root, NOISE))
    more = noise | _matching(root, BOILERPLATE)
    given = next((n.attrs["lang"] for n in root.find("html") if n.attrs.get("lang")), None)
    tried: list[tuple[float, str, str]] = []
    scored = [(n, squeeze(n.text(noise))) for n in root.find("div", "article", "section", "main", skip=noise)]
    scored = [(s, t) for n, t in scored if len(t) > MIN_CONTENT and (s := _element_score(n, t, noise)) > 0]
    if scored:
        t = max(scored, key=lambda x: x[0])[1]
        tried.append((score_text(t), t, "readability"))
    for method, skip, selectors in (("boilerplate", more, CONTAINERS), ("selectors", noise, PREFERRED)):
        for c in selectors:
            t = "".join(n.text(skip) for n in select(root, c, skip))
            if len(t) > MIN_CONTENT:
                tried.append((score_text(squeeze(t)), squeeze(t), method))
                break
    best = max(tried, key=lambda x: x[0], default=(0.0, "", ""))
    if best[0] <= 0:
        t = squeeze(root.text(noise))
        best = (score_text(t), t, "body")
    language = given or ("ms" if best[2] == "selectors" else "en")
    return best[1], _title(root).strip(), best[0], best[2], language, len(more if best[2] == "boilerplate" else noise)


def bullets_of(content: str) -> list[str]:
    return [m[2].strip() for line in content.split("\n") if (m := re.match(BULLET, line, re.I))]


def heading_sections(html: str) -> list[dict]:
    """Sections of headings, at most two levels deep: a heading belongs to the last top section of a lower level."""
    root = parse(html)
    out: list[dict] = []
    tops: list[dict] = []
    for n in root.find(*HEADINGS):
        title, level = squeeze(n.text()), int(n.tag[1])
        if not title:
            continue
        parts = []
        for x in n.following():
            if x.tag in HEADINGS and int(x.tag[1]) <= level:
                break
            if t := x.text().strip():
                parts.append(t)
        content = "\n\n".join(parts)
        parent = next((t for t in reversed(tops) if t["level"] < level), None)
        bullets = bullets_of(content)
        s = {"section_id": f"section-{len(out) + 1}", "parent_id": parent and parent["section_id"], "title": title, "level": level, "ord": len(out), "content": content, "words": len(re.split(r"\s+", content)), "bullets": bullets}
        out.append(s)
        if parent is None:
            tops.append(s)
    return out


def text_sections(text: str) -> list[dict]:
    """Sections of a text without headings, by what its lines begin with."""
    out: list[dict] = []
    tops: list[dict] = []
    cur, buffer = None, []

    def close() -> None:
        if cur is not None and buffer:
            cur["content"] = "\n".join(buffer).strip()
            cur["words"], cur["bullets"] = len(re.split(r"\s+", cur["content"])), bullets_of(cur["content"])

    for line in (x for x in (y.strip() for y in text.split("\n")) if x):
        found = None
        for level, pattern in ((1, TITLE_LINE), (2, SECTION_LINE), (3, SUBSECTION_LINE)):
            if m := re.match(pattern, line, re.I):
                found = (m[2].strip(), level)
                break
        else:
            if any(re.match(p, line, re.I) for p in TOPIC_LINES):
                found = (line, 2)
        if found is None:
            buffer.append(line)
            continue
        close()
        parent = None if found[1] == 1 else next((t for t in reversed(tops) if t["level"] < found[1]), None)
        cur = {"section_id": f"section-{len(out) + 1}", "parent_id": parent and parent["section_id"], "title": found[0], "level": found[1], "ord": len(out), "content": "", "words": 0, "bullets": []}
        out.append(cur)
        if parent is None:
            tops.append(cur)
        buffer = []
    close()
    return out


def structure(html: str, text: str) -> dict:
    """title, language, method, sections of a page and their totals; its cleaned text serves where it has no headings."""
    root = parse(html)
    found, method = heading_sections(html), "html-headings"
    if not found:
        found = text_sections(text)
        method = "text-patterns" if found else "hybrid"
    depth = 0 if not found else 2 if any(s["parent_id"] for s in found) else 1
    language = next((n.attrs["lang"] for n in root.find("html") if n.attrs.get("lang")), None) or language_of(text)
    return {"title": _title(root) or "Untitled Document", "language": language, "method": method, "sections": found, "total_sections": len(found), "max_depth": depth, "word_count": sum(s["words"] for s in found), "structure_type": "flat" if depth <= 1 else "mixed"}


def language_of(text: str) -> str:
    low = text.lower()
    return "ms" if sum(w in low for w in tx.MALAY) > sum(w in low for w in tx.ENGLISH) else "en"


def image_alts(html: str) -> list[str]:
    """Alternative texts of more than three characters."""
    return [a for n in parse(html).find("img") if len(a := n.attrs.get("alt", "").strip()) > 3]


def pagination_links(html: str, url: str, most: int = 5) -> list[str]:
    """The first few different pages that links to further pages name, selector by selector."""
    root, out = parse(html), []
    try:
        base = "{0.scheme}://{0.netloc}/".format(urlsplit(url))
    except ValueError:
        return []
    anchors = root.find("a")
    for selector in PAGINATION:
        if m := re.fullmatch(r"a:contains\((.+)\)", selector):
            found = [a for a in anchors if m[1] in a.text()]
        elif selector.startswith("a["):
            found = [a for a in anchors if matches(a, selector[1:])]
        else:
            found = select(root, selector)
        for a in found:
            href = a.attrs.get("href", "")
            if not href:
                continue
            try:
                full = href if href.startswith("http") else urljoin(base, href)
            except ValueError:
                continue
            if full != url and full not in out:
                out.append(full)
    return out[:most]


def page_links(html: str, url: str) -> list[str]:
    """Internal pages a page links to, in first-seen order."""
    base, out = urlsplit(url), []
    for a in parse(html).find("a"):
        href = a.attrs.get("href", "")
        if not href or href.startswith(("#", "javascript:", "mailto:")):
            continue
        try:
            full = urljoin(url, href)
            u = urlsplit(full)
        except ValueError:
            continue
        if (u.scheme, u.netloc) == (base.scheme, base.netloc) and full != url and not u.path.lower().endswith(SKIPPED) and full not in out:
            out.append(full)
    return out


def _cell(n: Node) -> str:
    """A cell's text; of one with links only these, with their targets; of one with a list its items."""
    if n.find("ul", "ol"):
        return "; ".join(i.text().strip() for i in n.find("li"))
    if n.find("a"):
        return ", ".join(f"{a.text().strip()} ({href})" if (href := a.attrs.get("href")) else a.text().strip() for a in n.find("a"))
    return n.text().strip()


def page_tables(html: str) -> list[dict]:
    """Tables with their header row, data rows (padded by column spans) and kind; tables without cells are left out."""
    out = []
    for t in parse(html).find("table"):
        inner = frozenset(id(x) for x in t.find("table"))
        spans = any("colspan" in n.attrs or "rowspan" in n.attrs for n in t.walk())

        def cells(row: Node, value, inner=inner) -> list[str]:
            got = []
            for c in row.find("td", "th", skip=inner):
                wide = max(int(w) if (w := c.attrs.get("colspan", "1")).isdigit() else 1, 1)
                got += [value(c), *[""] * (wide - 1)]
            return got

        rows = t.find("tr", skip=inner)
        head = [r for h in t.find("thead", skip=inner) for r in h.find("tr")][:1] or rows[:1]
        headers = cells(head[0], lambda c: c.text().strip()) if head else []
        body = [r for b in t.find("tbody", skip=inner) for r in b.find("tr", skip=inner)] or rows[1 if headers else 0 :]
        data = [r for r in (cells(b, _cell) for b in body) if any(r)]
        caption = "".join(c.text() for c in t.find("caption", skip=inner)).strip() or None
        if headers or data:
            out.append({"caption": caption, "summary": t.attrs.get("summary") or None, "headers": headers, "n_rows": len(data), "n_columns": max([len(headers), *map(len, data)]), "rows": ["\t".join(r) for r in data], "kind": "nested" if inner else "complex" if spans else "simple"})
    return out


def page_rules(html: str, body: str) -> dict:
    root = parse(html)
    found = {"program_name": next((squeeze(n.text()) for n in root.find("h1")), None) or None}
    matched = int(found["program_name"] is not None)
    for name, words in RULES:
        head = next((n for n in root.find(*HEADINGS) if any(w in n.text().lower() for w in words)), None)
        found[name] = []
        if head:
            matched += 1
            part = []
            for x in head.following():
                if x.tag in HEADINGS:
                    break
                part.append(x)
            for tag in ("li", "p"):
                found[name] = found[name] or [s for x in part for n in x.find(tag) if (s := n.text().strip())]
    for name, pattern in (("phone", tx.PHONE), ("email", tx.EMAIL), ("fee", tx.FEE)):
        m = re.search(pattern, body)
        found[name] = m[0] if m else None
        matched += bool(m)
    at = body.find(found["fee"]) if found["fee"] else -1
    found["fee_context"] = body[max(0, at - 100) : at + 100].strip() if at >= 0 else None
    return found | {"confidence": min(matched / 7, 1.0)}


def estimate(s: str) -> int:
    return math.ceil(len(s) / 3.5)


def tail(s: str, budget: int = OVERLAP) -> str:
    """Sentences from the end that fit the budget."""
    out, used = "", 0
    for x in reversed([y for y in (p.strip() for p in re.split("[.!?]+", s)) if len(y) > 10]):
        if used + estimate(x) > budget:
            break
        out, used = x + (" " + out if out else ""), used + estimate(x)
    return out


def chunk_sections(sections: list[dict]) -> list[dict]:
    """Chunks of whole sections, of paragraphs where a section is too long, each with the end of the one before."""
    chunks: list[dict] = []
    children: dict = {}
    for s in sections:
        children.setdefault(s["parent_id"], []).append(s)
    tops = children.get(None, [])

    def add(s: dict, body: str, tokens: int, place: int) -> None:
        chunks.append(_chunk(body.strip(), tokens, "section", s["title"], s["level"], place))

    for place, s in ((n, y) for n, top in enumerate(tops) for y in (top, *children.get(top["section_id"], []))):
        head = f"{s['title']}\n\n"
        whole = (head + s["content"] + ("\n\n" + "\n".join(f"• {b}" for b in s["bullets"]) if s["bullets"] else "")).strip()
        if estimate(whole) <= MAX_TOKENS:
            add(s, whole, estimate(whole), place)
            continue
        cur, used = head, estimate(head)
        for p in (x for x in (y.strip() for y in re.split(r"\n\s*\n", s["content"])) if x):
            if used + estimate(p) > MAX_TOKENS and cur.strip():
                add(s, cur, used, place)
                cur = tail(cur) + p
                used = estimate(cur)
            else:
                cur += ("\n\n" if cur.strip() else "") + p
                used += estimate(p)
        if cur.strip() and used >= MIN_TOKENS:
            add(s, cur, used, place)
    return _overlapped(chunks)


def _chunk(text: str, tokens: int, kind: str, section: str, level: int, place: int) -> dict:
    low = text.lower()
    kinds = [k for line in text.split("\n") for k, p in tx.BOUNDARIES if re.search(p, line.strip())]
    topics = [t for t, words in tx.TOPICS.items() if any(w in low for w in words)]
    return {"section": section, "level": level, "place": place, "kind": kind, "text": text, "tokens": tokens, "boundaries": list(dict.fromkeys(kinds)), "topic_keywords": topics, "overlap": False, "overlap_next": False}


def _overlapped(chunks: list[dict]) -> list[dict]:
    """Every chunk begins with the end of the one before, as that one stands then."""
    for before, after in zip(chunks, chunks[1:], strict=False):
        if t := tail(before["text"]):
            after["text"] = f"{t}\n\n{after['text']}"
            after["tokens"], after["overlap"], before["overlap_next"] = estimate(after["text"]), True, True
    return [c | {"chunk_index": i} for i, c in enumerate(chunks)]


def plain_chunks(text: str) -> list[dict]:
    """Chunks of a text without structure: of paragraphs if it has several, else of sentences over ten characters."""
    parts = [x for x in (y.strip() for y in re.split(r"\n\s*\n", text)) if x]
    kind, glue = "paragraph", "\n\n"
    if len(parts) <= 1:
        parts, kind, glue = [x for x in (y.strip() for y in re.split("[.!?]+", text)) if len(x) > 10], "mixed", " "
    chunks, cur, used = [], "", 0
    for p in parts:
        if used + estimate(p) > MAX_TOKENS and cur:
            chunks.append(_chunk(cur.strip(), used, kind, "Content", 1, len(chunks) + 1))
            cur = tail(cur) + p
            used = estimate(cur)
        else:
            cur += (glue if cur else "") + p
            used += estimate(p)
    if cur.strip():
        chunks.append(_chunk(cur.strip(), used, kind, "Content", 1, len(chunks) + 1))
    return _overlapped(chunks)


def _after_heading(n: Node) -> list[str]:
    out = []
    for x in n.following():
        if x.tag in HEADINGS and int(x.tag[1]) <= int(n.tag[1]):
            break
        out.append(x.text().strip())
    return out


def heading_chunks(html: str, least: int = 50, count: Callable[[str], int] = estimate) -> list[dict]:
    """One chunk for each heading with its following siblings, of fifty characters or more."""
    out = []
    for n in parse(html).find(*HEADINGS):
        text = "\n".join([n.text().strip(), *_after_heading(n)]).strip()
        if len(text) >= least:
            out.append({"chunk_index": len(out), "heading": n.text().strip(), "level": int(n.tag[1]), "text": text, "tokens": count(text), "section_type": section_kind(n.text().strip())})
    return out


def section_kind(heading: str) -> str:
    low = heading.lower()
    return next((k for k, words in tx.SECTION_TYPES if any(w in low for w in words)), "other")


def token_chunks(text: str, most: int = 500, count: Callable[[str], int] = estimate) -> list[dict]:
    """Sentences packed while their tokens fit; the whole text where it has no sentence end."""
    out, cur, used = [], [], 0

    def close() -> None:
        out.append({"chunk_index": len(out), "heading": "Content", "level": 0, "text": " ".join(cur), "tokens": used, "section_type": "other"})

    for s in re.findall(r"[^.!?]+[.!?]+", text) or [text]:
        n = count(s)
        if used + n > most and cur:
            close()
            cur, used = [], 0
        cur.append(s.strip())
        used += n
    if cur:
        close()
    return out


def _cut(content: str, size: int, overlap: int) -> list[tuple[int, str]]:
    """(place, piece): pieces of at most size characters, each beginning overlap characters before the last one's end.
    It stops at the piece that reaches the end."""
    out, at = [], 0
    while True:
        rest = content[at:]
        n = min(size, len(rest))
        if n < len(rest) and (stop := rest[:n].rfind(".")) > n * 0.7:
            n = stop + 1
        out.append((at, rest[:n]))
        if n >= len(rest):
            return out
        at += max(1, n - overlap)


def _char_tail(text: str, size: int) -> str:
    if len(text) <= size:
        return text
    end = text[-size:]
    at = end.find(". ")
    return end[at + 2 :] if at > 0 else end


def document_chunks(content: str, html: str = "", size: int = 1000, overlap: int = 100, least: int = 200) -> list[dict]:
    """Chunks of headed sections and then of tables; of paragraphs where there are none of either."""
    out: list[dict] = []

    def add(text: str, at: int, kind: str, heading: str | None = None, level: int | None = None) -> None:
        out.append({"chunk_index": len(out), "text": text, "start": at, "end": at + len(text), "kind": kind, "heading": heading, "level": level, "tokens": math.ceil(len(text) / 4)})

    root, at = parse(html), 0
    for n in root.find(*HEADINGS) if html else ():
        title, body = n.text().strip(), "\n\n".join(x for x in _after_heading(n) if x)
        if title and len(body) >= least:
            for place, piece in _cut(body, size, overlap):
                add(piece, at + place, "section", title, int(n.tag[1]))
            at += len(body)
    for t in root.find("table") if html else ():
        text = t.text().strip()
        if len(text) >= least:
            add(text, at, "table")
            at += len(text)
    if out:
        return out
    at, cur = 0, ""
    for p in (x.strip() for x in re.split(r"\n\s*\n", content) if x.strip()):
        if len(cur) + len(p) > size and cur:
            add(cur, at - len(cur), "paragraph")
            cur = _char_tail(cur, overlap) + p
        else:
            cur += ("\n\n" if cur else "") + p
        at += len(p) + 2
    if len(cur.strip()) >= least:
        add(cur, at - len(cur), "paragraph")
    return out


def _each(pages: DataFrame, schema: str, rows: Callable[[str, str], list[dict]]) -> DataFrame:
    """rows(html, url) of each page with its page_id; null html is an empty page."""
    cols = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [{"page_id": i} | r for i, u, h in zip(b["page_id"], b["url"], b["html"], strict=True) for r in rows(h or "", u or "")]
            yield pd.DataFrame(out, columns=cols)

    return pages.select("page_id", "url", "html").mapInPandas(run, schema)


def _texts(docs: DataFrame, schema: str, rows: Callable[[str], list[dict]]) -> DataFrame:
    """rows(text) of each document with its doc_id; a null text is an empty one."""
    cols = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([{"doc_id": i} | r for i, t in zip(b["doc_id"], b["text"], strict=True) for r in rows(t or "")], columns=cols)

    return docs.select("doc_id", "text").mapInPandas(run, schema)


def clean_pages(pages: DataFrame) -> DataFrame:
    def one(h, u):
        return [dict(zip(("text", "title", "score", "method", "language", "removed"), clean(h), strict=True))]

    return _each(pages, "page_id long, text string, title string, score double, method string, language string, removed int", one)


_SECTION = "page_id long, section_id string, parent_id string, title string, level int, ord int, content string, words int, bullets array<string>"


def sections(pages: DataFrame) -> DataFrame:
    return _each(pages, _SECTION, lambda h, u: heading_sections(h))


def structures(pages: DataFrame) -> DataFrame:
    """One row for each page: title, language, method and totals over its sections."""
    return _each(pages, "page_id long, title string, language string, method string, total_sections int, max_depth int, word_count int, structure_type string", lambda h, u: [structure(h, clean(h)[0])])


def pattern_sections(docs: DataFrame) -> DataFrame:
    return _texts(docs, _SECTION.replace("page_id", "doc_id"), text_sections)


def links(pages: DataFrame) -> DataFrame:
    return _each(pages, "page_id long, ord int, link string", lambda h, u: [{"ord": i, "link": x} for i, x in enumerate(page_links(h, u))])


def paginations(pages: DataFrame) -> DataFrame:
    return _each(pages, "page_id long, ord int, link string", lambda h, u: [{"ord": i, "link": x} for i, x in enumerate(pagination_links(h, u))])


def images(pages: DataFrame) -> DataFrame:
    return _each(pages, "page_id long, ord int, alt string", lambda h, u: [{"ord": i, "alt": x} for i, x in enumerate(image_alts(h))])


def tables(pages: DataFrame) -> DataFrame:
    return _each(pages, "page_id long, caption string, summary string, headers array<string>, n_rows int, n_columns int, rows array<string>, kind string", lambda h, u: page_tables(h))


def rules(pages: DataFrame) -> DataFrame:
    return _each(pages, "page_id long, program_name string, eligibility array<string>, required_documents array<string>, benefits array<string>, phone string, email string, fee string, fee_context string, confidence double", lambda h, u: [page_rules(h, clean(h)[0])])


_CHUNK = "chunk_index int, section string, level int, place int, kind string, text string, tokens int, boundaries array<string>, topic_keywords array<string>, overlap boolean, overlap_next boolean"


def semantic_chunks(pages: DataFrame) -> DataFrame:
    """Chunks of each page's structure, with the page's title and language."""
    def one(h, u):
        s = structure(h, clean(h)[0])
        return [c | {"title": s["title"], "language": s["language"]} for c in chunk_sections(s["sections"])]

    return _each(pages, f"page_id long, {_CHUNK}, title string, language string", one)


def plain_text_chunks(docs: DataFrame) -> DataFrame:
    return _texts(docs, f"doc_id long, {_CHUNK}", plain_chunks)


def section_chunks(pages: DataFrame) -> DataFrame:
    return _each(pages, "page_id long, chunk_index int, heading string, level int, text string, tokens int, section_type string", lambda h, u: heading_chunks(h) or token_chunks(clean(h)[0]))


def chunked_documents(pages: DataFrame) -> DataFrame:
    return _each(pages, "page_id long, chunk_index int, text string, start int, end int, kind string, heading string, level int, tokens int", lambda h, u: document_chunks(clean(h)[0], h))


def chunking_totals(chunks: DataFrame, by: str = "page_id") -> DataFrame:
    """Per document its chunks, their tokens (sum, rounded mean), and the shares with an overlap and with a boundary."""
    n, share = F.count(F.lit(1)), lambda c: F.round(F.count_if(c) / F.count(F.lit(1)), 2)
    return chunks.groupBy(by).agg(n.alias("total_chunks"), F.sum("tokens").alias("total_tokens"), F.round(F.avg("tokens")).cast("long").alias("avg_chunk_size"), share(F.col("overlap") | F.col("overlap_next")).alias("overlap_ratio"), share(F.size("boundaries") > 0).alias("boundary_preservation"))


def chunk_metadata(pages: DataFrame) -> DataFrame:
    """Semantic chunks with their 24 fields of metadata; the parse is Python's, all metadata are column expressions.

    Ministry and audience come from the page's title and source (the host of its address), the rest of the
    classification from the chunk's text with its overlap.
    """
    c = semantic_chunks(pages).join(pages.select("page_id", "url"), "page_id")
    t, source = F.col("text"), F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit(""))
    title = F.when(F.col("title") == "", "Untitled").otherwise(F.col("title"))
    dates = tx.date_roles(t)
    meta = {"source": source, "url": F.col("url"), "language": F.col("language"), "document_title": title, "topics": tx.service_topics(t), "document_type": tx.document_type(t), "category": tx.content_category(t), "ministry": tx.ministry(F.concat_ws(" ", "title", source)), "department": tx.department(source), "program": tx.program_name(t), "audience": tx.audience(F.col("title")), "section": F.col("section"), "level": F.col("level"), "last_updated": dates["last_updated"], "effective_date": dates["effective_date"], "expiry_date": dates["expiry_date"], "confidence": tx.confidence(t), "completeness": tx.completeness(t), "keywords": tx.keywords(t), "entities": tx.entities(t), "chunk_type": F.col("kind"), "chunk_position": F.col("place"), "has_overlap": F.col("overlap") | F.col("overlap_next"), "topic_keywords": F.col("topic_keywords"), "boundaries": F.col("boundaries"), "tokens": F.col("tokens"), "chunk_hash": F.sha2(t, 256)}
    return c.select("page_id", "chunk_index", *[v.alias(k) for k, v in meta.items()])
