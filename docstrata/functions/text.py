"""Text classifiers, scores, normalisers and chunkers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that results depend on.
EXPIRED = r"/bajet-\d{4}-old/|/old/|/archive/|/archived/|/deprecated/|/expired/|/v1/|/v2/|-\d{4}$|_old$|_archive$"
PAGE_TYPES = [("program", ("program", "bantuan")), ("policy", ("policy", "dasar")), ("form", ("form", "borang")), ("guide", ("guide", "panduan"))]
TOPICS = {
    "eligibility": ("eligible", "qualify", "requirement", "criteria", "layak", "syarat", "kelayakan"),
    "application": ("apply", "application", "submit", "form", "mohon", "permohonan", "borang"),
    "documents": ("document", "certificate", "proof", "dokumen", "sijil", "bukti"),
    "process": ("process", "procedure", "step", "proses", "prosedur", "langkah"),
    "benefits": ("benefit", "assistance", "support", "bantuan", "faedah", "sokongan"),
    "contact": ("contact", "enquiry", "office", "hubungi", "pertanyaan", "pejabat"),
    "deadline": ("deadline", "due date", "before", "tarikh", "sebelum", "had masa"),
    "fee": ("fee", "cost", "payment", "yuran", "kos", "bayaran"),
}
SERVICE_TOPICS = {
    "healthcare": ("health", "medical", "hospital", "kesihatan", "perubatan"),
    "education": ("education", "school", "university", "pendidikan", "sekolah"),
    "finance": ("finance", "tax", "loan", "kewangan", "cukai", "pinjaman"),
    "housing": ("housing", "home", "property", "perumahan", "rumah"),
    "employment": ("job", "work", "employment", "kerja", "pekerjaan"),
    "social_welfare": ("welfare", "assistance", "support", "bantuan", "kebajikan"),
}
DOCUMENT_TYPES = [("policy", "policy|dasar|polisi"), ("procedure", "procedure|prosedur|tatacara"), ("form", "form|borang|formulir"), ("guide", "guide|panduan|manual"), ("announcement", "announcement|pengumuman|notis"), ("law", "act|law|akta|undang"), ("regulation", "regulation|peraturan|kaedah")]
CATEGORIES = [("eligibility", "eligib|layak|qualify|syarat|criteria"), ("application", "apply|mohon|permohonan|submit"), ("benefits", "benefit|bantuan|faedah|assistance"), ("requirements", "require|perlu|dokumen|document"), ("process", "process|proses|step|langkah"), ("contact", "contact|hubungi|enquiry|pertanyaan")]
MINISTRIES = [("Ministry of Health", "ministry of health|kementerian kesihatan|moh"), ("Ministry of Education", "ministry of education|kementerian pendidikan|moe"), ("Ministry of Finance", "ministry of finance|kementerian kewangan|mof"), ("Ministry of Home Affairs", "ministry of home affairs|kementerian dalam negeri"), ("Ministry of Women", "ministry of women|kementerian wanita"), ("Prime Minister's Department", "prime minister|jabatan perdana menteri|jpm")]
AUDIENCES = [("Citizens", "citizen|rakyat|public|awam"), ("Students", "student|pelajar|murid"), ("Businesses", "business|perniagaan|company|syarikat"), ("Elderly", "elderly|warga emas|senior"), ("Youth", "youth|belia|remaja"), ("Women", "women|wanita|perempuan"), ("Disabled", "disabled|oku|kurang upaya")]
GOV_KEYWORDS = ("policy", "regulation", "law", "act", "procedure", "application", "eligibility", "requirement", "document", "ministry", "department", "government", "public", "citizen", "service", "benefit", "program")
MALAY = ("dan", "atau", "untuk", "dengan", "pada", "adalah", "yang", "ini", "itu", "akan")
ENGLISH = ("and", "or", "for", "with", "on", "is", "the", "this", "that", "will")
PHONE = r"(\+?6?0?1[0-9]{1,2}[-\s]?[0-9]{7,8})|(\+?60[0-9]{1,2}[-\s]?[0-9]{7,8})"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
FEE = r"(?i)(RM|MYR)\s*([0-9,]+(\.[0-9]{2})?)"
DATE = r"(?i)\d{1,2}[\/\-\.]\d{1,2}[\/\-\.]\d{2,4}|\d{1,2}\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec|Januari|Februari|Mac|April|Mei|Jun|Julai|Ogos|September|Oktober|November|Disember)\s+\d{2,4}"
IC_NUMBER = r"\d{6}-\d{2}-\d{4}"
ENTITY_PHONE = r"0\d{1,2}-\d{7,8}|\+60\d{1,2}-\d{7,8}"
MONEY = r"(?i)RM\s*\d+(?:,\d{3})*(?:\.\d{2})?|\d+(?:,\d{3})*(?:\.\d{2})?\s*ringgit"
ADDRESS = r"\d+[A-Za-z]?,?\s+[A-Za-z\s]+,\s+\d{5}\s+[A-Za-z\s]+"
ENTITIES = {"ic_number": IC_NUMBER, "phone": ENTITY_PHONE, "email": EMAIL, "dates": DATE, "money": MONEY, "addresses": ADDRESS}
# Word boundaries are those of ASCII letters, digits and _.
BEGIN, END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
PHRASE = rf"{BEGIN}[A-Z][a-z]+(?:\s+[A-Z][a-z]+){{1,2}}{END}"
GOV_TERM = rf"(?i){BEGIN}(?:ministry|kementerian|department|jabatan|policy|dasar|program|bantuan|assistance|application|permohonan){END}"
DATE_ROLES = [("effective_date", "(?i)effective|berkuat kuasa|mula"), ("expiry_date", "(?i)expir|tamat|until|hingga"), ("last_updated", "(?i)updated|dikemaskini|last")]
DEPARTMENT = "(?i)department|jabatan|unit|bahagian"
PROGRAM_WORDS = ("program", "bantuan", "scheme", "skim")
COMPLETE_PARTS = ("eligib|layak", "apply|mohon", "require|perlu|dokumen", "contact|hubungi", "benefit|bantuan|faedah")
SECTION_TYPES = [("eligibility", ("eligib", "kelayakan")), ("benefits", ("benefit", "manfaat", "faedah")), ("process", ("process", "proses", "cara", "how to")), ("requirements", ("require", "document", "dokumen")), ("fees", ("fee", "cost", "bayaran", "kos")), ("contact", ("contact", "hubungi"))]
BOUNDARIES = [("section_header", r"^[A-Z][A-Z\s]+:?$|^\d+\."), ("list_item", r"^[•\-\*]|^\d+\)"), ("question", r"\?$")]
REPEATED_PHRASE = r"(?i)^(Application Process|Proses Permohonan)$|^(Required Documents|Dokumen Diperlukan)$|^(Contact Information|Maklumat Hubungan)$|^(Terms and Conditions|Terma dan Syarat)$"
ENCODING = [("â€™", "'"), ("â€œ", '"'), ("â€", '"'), ("â€¢", "•"), ('â€"', "–"), ("Â", ""), ("\u00a0", " "), ("\u2019", "'"), ("\u201c", '"'), ("\u201d", '"'), ("\u2013", "–"), ("\u2014", "—"), ("\u2022", "•")]
OCR = [(f"{BEGIN}1{END}", "I"), (f"{BEGIN}0{END}", "O"), ("rn", "m"), (r"\|", "l"), ("(?i)Kerajaan", "Kerajaan"), ("(?i)Malaysia", "Malaysia"), ("(?i)Kementerian", "Kementerian")]
PAGE_NUMBER = r"(?i)^Page\s+\d+$|^\d+\s*$|^Halaman\s+\d+$|^Muka\s+Surat\s+\d+$"
HEADER = r"(?i)^(MINISTRY|KEMENTERIAN|DEPARTMENT|JABATAN|GOVERNMENT OF|KERAJAAN|OFFICIAL|RASMI|CONFIDENTIAL|SULIT)"
NAVIGATION = r"(?i)^(HOME|UTAMA|BACK|KEMBALI|NEXT|SETERUSNYA|PREVIOUS|SEBELUM|MENU|NAVIGATION|NAVIGASI|SEARCH|CARI|LOGIN|LOG MASUK)$"
MAX_TEXT, MAX_HTML = 500_000, 1_000_000
SUFFIX = "\n\n[Content truncated due to size limits]"


def _any(low: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def _count(low: Column, words) -> Column:
    return sum((low.contains(w).cast("int") for w in words), F.lit(0))


def _first(text: Column, table, default: str) -> Column:
    out = F
    for name, pattern in table:
        out = out.when(text.rlike(f"(?i){pattern}"), F.lit(name))
    return out.otherwise(F.lit(default))


def _all(conditions, default=None) -> Column:
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in conditions]), lambda x: x.isNotNull())
    return found if default is None else F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def trim(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def expired_path(url: Column) -> Column:
    return url.rlike(EXPIRED)


def token_estimate(text: Column, per: float) -> Column:
    return F.ceil(F.length(text) / F.lit(float(per))).cast("long")


def word_count(text: Column) -> Column:
    return F.size(F.split(text, r"\s+"))


def detect_language(text: Column) -> Column:
    """ms if more of its ten words occur as substrings than of the English ones; ties are English."""
    low = F.lower(text)
    return F.when(_count(low, MALAY) > _count(low, ENGLISH), "ms").otherwise("en")


def page_type(title: Column, text: Column) -> Column:
    low, out = F.lower(F.concat_ws(" ", title, text)), F
    for name, words in PAGE_TYPES:
        out = out.when(_any(low, words), name)
    return out.otherwise("general")


def topic_keywords(text: Column) -> Column:
    low = F.lower(text)
    return _all([(n, _any(low, w)) for n, w in TOPICS.items()])


def service_topics(text: Column) -> Column:
    low = F.lower(text)
    return _all([(n, _any(low, w)) for n, w in SERVICE_TOPICS.items()])


def document_type(text: Column) -> Column:
    return _first(text, DOCUMENT_TYPES, "guide")


def content_category(text: Column) -> Column:
    """The last matching category; contact where none matches."""
    return _first(text, CATEGORIES[::-1], "contact")


def ministry(text: Column) -> Column:
    return _first(text, MINISTRIES, "Unknown Ministry")


def department(source: Column) -> Column:
    return F.when(source.rlike(DEPARTMENT), source).otherwise("Unknown Department")


def audience(text: Column) -> Column:
    return _all([(n, text.rlike(f"(?i){p}")) for n, p in AUDIENCES], "Citizens")


def program_name(text: Column) -> Column:
    one = [F.nullif(trim(F.regexp_extract(text, rf"(?i){w}\s+([A-Z][A-Za-z\s]+)", 1)), F.lit("")) for w in PROGRAM_WORDS]
    return F.coalesce(*one)


def keywords(text: Column) -> Column:
    """The first ten phrases of two or three capitalised words, then government terms, lower-cased, each once."""
    phrases = F.slice(F.regexp_extract_all(text, F.lit(PHRASE), F.lit(0)), 1, 10)
    return F.array_distinct(F.transform(F.concat(phrases, F.regexp_extract_all(text, F.lit(GOV_TERM), F.lit(0))), F.lower))


def _tagged(kind: str):
    return lambda m: F.concat(F.lit(f"{kind}:"), m)


def entities(text: Column) -> Column:
    return F.concat(*[F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), _tagged(k)) for k, p in ENTITIES.items()])


def date_roles(text: Column) -> Column:
    """effective_date, expiry_date, last_updated: the last date whose surroundings say so, 50 characters on either
    side of where the same date is first written."""
    def role(d):
        at = F.instr(text, d)
        near = F.substring(text, F.greatest(at - 50, F.lit(1)), F.length(d) + 50 + F.least(at - 1, F.lit(50)))
        kind = F
        for name, pattern in DATE_ROLES:
            kind = kind.when(near.rlike(pattern), name)
        return F.struct(kind.otherwise(F.lit(None)).alias("kind"), d.alias("date"))

    found = F.transform(F.regexp_extract_all(text, F.lit(DATE), F.lit(0)), role)
    last = lambda name: F.try_element_at(F.filter(found, lambda x: x["kind"] == name), F.lit(-1))["date"].alias(name)
    return F.struct(*[last(n) for n, _ in DATE_ROLES])


def fee_context(text: Column) -> Column:
    """A hundred characters on either side of where the first fee begins; null without one."""
    fee = F.nullif(F.regexp_extract(text, FEE, 0), F.lit(""))
    at = F.instr(text, fee)
    return trim(F.substring(text, F.greatest(at - 100, F.lit(1)), 100 + F.least(at - 1, F.lit(100))))


def section_type(heading: Column) -> Column:
    low, out = F.lower(heading), F
    for name, words in SECTION_TYPES:
        out = out.when(_any(low, words), name)
    return out.otherwise("other")


def boundaries(text: Column) -> Column:
    """Kinds of lines that a text has (headers, list items, questions), in the order they first appear."""
    kinds = lambda l: F.filter(F.array(*[F.when(trim(l).rlike(p), F.lit(n)) for n, p in BOUNDARIES]), lambda k: k.isNotNull())
    return F.array_distinct(F.flatten(F.transform(F.split(text, "\n"), kinds)))


def preview(text: Column, most: int = 300) -> Column:
    return F.concat(F.substring(text, 1, most), F.lit("..."))


def query_key(text: Column) -> Column:
    """Look-up key of a cached query: the hash of its trimmed lower-case form."""
    return F.sha2(F.lower(trim(text)), 256)


def relative_time(at: Column, now: Column) -> Column:
    """Just now, minutes, hours, or the day."""
    minutes = F.floor((F.unix_micros(now) - F.unix_micros(at)) / 60_000_000)
    return F.when(minutes < 1, "Just now").when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago"))).when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h ago"))).otherwise(F.date_format(at, "yyyy-MM-dd"))


def overlap_tail(text: Column, size: int = 100) -> Column:
    """The last size characters, from after the first sentence end in them if there is one; short texts whole."""
    tail = F.substring(text, -size, size)
    at = F.instr(tail, F.lit(". "))
    return F.when(F.length(text) <= size, text).when(at > 1, F.substring(tail, at + 2, F.lit(size))).otherwise(tail)


def sentence_cut(text: Column, size: int = 1000) -> Column:
    """Length of the first piece of at most size characters: to the last full stop if beyond 70 % of the limit."""
    head = F.substring(text, 1, size)
    last = F.lit(size) - F.instr(F.reverse(head), F.lit("."))  # its place from 0
    return F.when(F.length(text) <= size, F.length(text)).when(F.contains(head, F.lit(".")) & (last > 0.7 * size), last + 1).otherwise(F.lit(size))


def contacts(text: Column) -> Column:
    get = lambda p: F.nullif(F.regexp_extract(text, p, 0), F.lit(""))
    return F.struct(get(PHONE).alias("phone"), get(EMAIL).alias("email"), get(FEE).alias("fee"))


def confidence(text: Column) -> Column:
    """Half, and a tenth for each sign of a substantial official text, added in order; at most one."""
    signs = [F.length(text) > 100, F.length(text) > 500, text.rlike(r"\d+\.|[A-Z]\.|•|-"), text.rlike("(?i)eligib|require|apply|contact"), text.rlike(DATE), text.rlike("(?i)ministry|kementerian|government|kerajaan")]
    score = F.lit(0.5)
    for s in signs:
        score = score + F.when(s, 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), score)


def completeness(text: Column) -> Column:
    """Share of six parts present; a second date is needed for the date part, and nothing present counts as half."""
    parts = [text.rlike(f"(?i){p}") for p in COMPLETE_PARTS]
    n = sum((p.cast("int") for p in parts), F.lit(0)) + (F.size(F.regexp_extract_all(text, F.lit(DATE), F.lit(0))) > 1).cast("int")
    return F.when(n == 0, 0.5).otherwise(n / 6.0)


def content_score(text: Column, least: int = 100) -> Column:
    low = F.lower(text)
    words = F.split(low, r"\s+")
    sentences = F.size(F.filter(F.split(text, "[.!?]+"), lambda s: F.length(trim(s)) > 10))
    score = F.least(F.length(text) / 100.0, F.lit(100.0)) + 2 * sentences + 50 * F.size(F.array_distinct(words)) / F.size(words) + 5 * _count(low, GOV_KEYWORDS)
    return F.when(F.length(text) < least, 0.0).otherwise(score)


def truncate(text: Column, most: int = MAX_TEXT, suffix: str = SUFFIX) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit(suffix)))


def truncation(text: Column, most: int = MAX_TEXT) -> Column:
    n = F.length(text)
    return F.struct(n.alias("original"), F.least(n, F.lit(most)).alias("kept"), (n > most).alias("truncated"), F.when(n == 0, 1.0).otherwise(F.least(n, F.lit(most)) / n).alias("ratio"))


def content_valid(text: Column, title: Column) -> Column:
    return (F.length(text) >= 100) & (F.length(title) > 0) & (F.length(title) <= 500)


def collapse(text: Column) -> Column:
    return trim(F.regexp_replace(text, r"(?U)\s+", " "))


def drop_lines(text: Column, pattern: str) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda l: ~trim(l).rlike(pattern)), "\n")


def count_lines(text: Column, pattern: str) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda l: trim(l).rlike(pattern)))


def _let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def keep_repeats(text: Column, most: int = 1, least: int = 3, key=lambda line: line) -> Column:
    """The first `most` lines of each key (of the trimmed line) stay; lines shorter than least all stay.

    Lines are sorted by key and place, so a line is compared with one neighbour only.
    """
    lines = F.array_sort(F.transform(F.split(text, "\n"), lambda l, i: F.struct(key(trim(l)).alias("k"), i.alias("i"), l.alias("l"))))
    stay = lambda s: F.filter(s, lambda x, j: (F.length(trim(x["l"])) < least) | F.coalesce(F.get(s, j - most)["k"] != x["k"], F.lit(True)))
    kept = F.array_sort(F.transform(_let(lines, stay), lambda x: F.struct(x["i"].alias("i"), x["l"].alias("l"))))
    return F.array_join(F.transform(kept, lambda x: x["l"]), "\n")


def dedupe_lines(text: Column, least: int = 3) -> Column:
    """First occurrence of each line stays, whatever the case of common headings; shorter lines all stay."""
    return keep_repeats(text, 1, least, lambda l: F.when(l.rlike(REPEATED_PHRASE), F.concat(F.lit("PHRASE:"), F.lower(l))).otherwise(l))


def consecutive_lines(text: Column) -> Column:
    """Without blank lines and lines equal to the one before, trimmed."""
    lines = lambda ls: F.filter(ls, lambda l, i: (trim(l) != "") & F.coalesce(trim(F.get(ls, i - 1)) != trim(l), F.lit(True)))
    return F.array_join(_let(F.split(text, "\n"), lines), "\n")


def fix_encoding(text: Column) -> Column:
    for bad, good in ENCODING:
        text = F.replace(text, F.lit(bad), F.lit(good))
    return text


def encoding_fixes(text: Column) -> Column:
    """Replacements that fix_encoding makes, those that change nothing included."""
    n = F.lit(0)
    for bad, good in ENCODING:
        n = n + F.floor((F.length(text) - F.length(F.replace(text, F.lit(bad), F.lit("")))) / len(bad)).cast("int")
        text = F.replace(text, F.lit(bad), F.lit(good))
    return n


def normalize_space(text: Column) -> Column:
    text = F.regexp_replace(text, r"[ \t]+", " ")
    text = F.regexp_replace(text, r"\n\s*\n\s*\n+", "\n\n")
    text = F.regexp_replace(text, r"(?m)[ \t]+$", "")
    # Runs of over four become four, shorter ones none; after the first rule there are only short ones.
    text = F.regexp_replace(F.regexp_replace(text, r"(?m)^[ \t]{1,4}(?![ \t])", ""), r"(?m)^[ \t]{5,}", "    ")
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def fix_ocr(text: Column) -> Column:
    for bad, good in OCR:
        text = F.regexp_replace(text, bad, good)
    return text


STEPS = ("encoding", "whitespace", "page_numbers", "headers", "duplicates")


def normalize(text: Column, steps: tuple[str, ...] = STEPS) -> Column:
    """All steps asked for in their fixed order, on texts of several lines; the last cleanup is always done."""
    return normalization(text, steps)["text"]


def normalization(text: Column, steps: tuple[str, ...] = STEPS) -> Column:
    """text, encoding_fixed, page_numbers_removed, duplicates_removed."""
    lines = lambda c: F.size(F.split(c, "\n"))
    zero = F.lit(0)
    fixed = encoding_fixes(text) if "encoding" in steps else zero
    text = fix_encoding(text) if "encoding" in steps else text
    text = normalize_space(text) if "whitespace" in steps else text

    def rest(t):
        pages = count_lines(t, PAGE_NUMBER) if "page_numbers" in steps else zero
        t = drop_lines(t, PAGE_NUMBER) if "page_numbers" in steps else t
        t = drop_lines(drop_lines(t, HEADER), NAVIGATION) if "headers" in steps else t

        def last(d):
            kept = dedupe_lines(d) if "duplicates" in steps else d
            removed = lines(d) - lines(kept) if "duplicates" in steps else zero
            clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(kept, r"^\n+|\n+\z", ""), r"\n{3,}", "\n\n"), r"[ \t]+", " ")
            return F.struct(trim(clean).alias("text"), fixed.alias("encoding_fixed"), pages.alias("page_numbers_removed"), removed.alias("duplicates_removed"))

        return _let(t, last)

    return _let(text, rest)


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), trim), lambda p: p != "")


def sentences(text: Column, least: int = 10) -> Column:
    return F.filter(F.transform(F.split(text, "[.!?]+"), trim), lambda s: F.length(s) > least)


def sentence_chunks(text: Column, most: int = 1000) -> Column:
    """Sentences packed while their length fits, joined by '. '; the whole text where there is none."""
    parts = F.filter(F.transform(F.split(text, "[.!?]+"), trim), lambda s: s != "")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(s, x):
        over = (F.length(s["cur"]) + F.length(x) > most) & (s["cur"] != "")
        joined = F.when(s["cur"] == "", x).otherwise(F.concat(s["cur"], F.lit(". "), x))
        return F.when(over, F.struct(F.concat(s["done"], F.array(F.trim(s["cur"]))).alias("done"), x.alias("cur"))).otherwise(F.struct(s["done"].alias("done"), joined.alias("cur")))

    out = F.aggregate(parts, empty, step, lambda s: F.when(s["cur"] != "", F.concat(s["done"], F.array(F.trim(s["cur"])))).otherwise(s["done"]))
    return F.when(F.size(out) > 0, out).otherwise(F.array(text))
