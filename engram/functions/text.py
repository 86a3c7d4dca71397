"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a character or run of each class counts, and the class as a pattern.
TEXT_SCORES = {
    "cjk": (1.0, r"[一-鿿㐀-䶿]"),
    "word": (1.5, r"[A-Za-z]+"),
    "number": (0.8, r"[0-9]+"),
    "punctuation": (0.5, r"[!-/:-@\[-`{-~]"),
    "whitespace": (0.3, r"\s+"),
}
BASE62 = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
STOPWORDS = ["the", "of", "and", "to", "in", "is", "it", "that", "de", "la", "le", "der", "die", "und", "el", "en"]


def tokens(text: Column, stopwords: list[str] | None = None) -> Column:
    """Lower-case alphabetic words of two letters or more, in order; words with digits, _ or - are none."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?<![\p{L}\p{N}_-])(\p{L}{2,}+)(?![\p{L}\p{N}_-])"), F.lit(1))
    if stopwords is None:
        return words
    stop = F.array(*map(F.lit, stopwords))
    return F.filter(words, lambda w: ~F.array_contains(stop, w))


def class_counts(text: Column) -> dict[str, Column]:
    counts = {k: F.regexp_count(text, F.lit(p)) for k, (_, p) in TEXT_SCORES.items()}
    rest = F.regexp_replace(text, r"[一-鿿㐀-䶿A-Za-z0-9!-/:-@\[-`{-~\s]", "")
    return counts | {"other": F.length(rest)}


def text_score(text: Column) -> Column:
    counts = class_counts(text)
    weights = {k: w for k, (w, _) in TEXT_SCORES.items()} | {"other": 0.5}
    return sum((counts[k] * F.lit(w) for k, w in weights.items()), F.lit(0.0))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def base62(number: Column, digits: int = 11) -> Column:
    """Of a number >= 0, as a string without leading zeros."""
    n = number.cast("decimal(38,0)")
    # a rest less the rest before it is a whole multiple, so no quotient is rounded
    rest = [F.lit(0).cast("decimal(38,0)"), *[F.pmod(n, F.lit(str(62**i)).cast("decimal(38,0)")) for i in range(1, digits + 1)]]
    each = [F.substr(F.lit(BASE62), ((rest[i + 1] - rest[i]) / F.lit(62**i).cast("decimal(20,0)") + 1).cast("int"), F.lit(1)) for i in range(digits)]
    return F.regexp_replace(F.concat(*reversed(each)), "^0+(?=.)", "")


def route(key: Column, partitions: int = 100) -> Column:
    """Stable partition 1.. of a key, from the first 8 hex digits of its md5."""
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % partitions) + 1


def event_time(ts: Column) -> Column:
    return F.date_format(ts, "MMMM dd, yyyy'('EEEE') at 'hh:mm a")


def epoch_ms(x: Column) -> Column:
    """Epoch seconds or milliseconds (from 1e12 on) to milliseconds."""
    return F.when(x >= 1_000_000_000_000, x).otherwise(x * 1000)


def any_epoch_ms(shown: Column, zone: Column | None = None) -> Column:
    """Milliseconds of a time written as epoch seconds, milliseconds or ISO text; that is in the zone (UTC) unless it has an offset."""
    number = shown.try_cast("double")
    return F.coalesce(epoch_ms(number).cast("long"), instant(shown, F.lit("UTC") if zone is None else zone) * 1000)


def all_shingles(words: Column, least: int = 2, most: int = 5, separator: str = " ") -> Column:
    """Runs of ``least`` to ``most`` words, joined by the separator, shorter runs first."""
    return F.flatten(F.array(*[shingles(words, width, separator) for width in range(least, most + 1)]))


def shingles(words: Column, width: int = 2, separator: str = " ") -> Column:
    """Runs of so many words, joined by blanks."""
    n = F.greatest(F.size(words) - width + 1, F.lit(0))
    parts = [F.slice(words, k, n).alias(f"w{k}") for k in range(1, width + 1)]  # zipped, so that no lambda makes the words anew
    return F.transform(F.arrays_zip(*parts), lambda z: F.concat_ws(separator, *[z[f"w{k}"] for k in range(1, width + 1)]))


def choice(answer: Column) -> Column:
    """The choice that an answer names, as (b): written (b), b), b. or as a first letter between blanks, a to h; null if none."""
    text = collapsed(F.lower(answer))
    # fixed values: the four forms, in the order they are tried
    forms = [r"\(([a-z])\)", r"\b([a-z])\)", r"\b([a-z])\.", r"(?:^|\s)([a-z])(?:\s|$)"]
    found = F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in forms[:3]], F.nullif(F.regexp_extract(F.regexp_extract(text, forms[3], 1), "^[a-h]$", 0), F.lit("")))
    return F.concat(F.lit("("), found, F.lit(")"))


def decisions(answer: Column) -> Column:
    """The clusters that an answer names, comma-joined; NEW if none."""
    named = F.regexp_extract_all(answer, F.lit(r"(gec_[0-9]+)"), F.lit(1))
    return F.coalesce(F.nullif(F.array_join(named, ","), F.lit("")), F.lit("NEW"))


def session_time(shown: Column) -> Column:
    """Epoch seconds of a time like 6:07 pm on 13 January, 2023; null if it isn't one."""
    return F.unix_seconds(F.try_to_timestamp(F.regexp_replace(F.regexp_replace(shown, "(?i) am on ", " AM on "), "(?i) pm on ", " PM on "), F.lit("h:mm a 'on' d MMMM, yyyy")))


def instant(shown: Column, zone: Column) -> Column:
    """Epoch seconds of an ISO time; without an offset of its own it is in the time zone. Null if it can't be read."""
    own = F.regexp_like(shown, F.lit(r"(Z|[+-]\d{2}:?\d{2})$"))
    return F.unix_seconds(F.when(own, shown).otherwise(F.concat(shown, F.lit(" "), zone)).try_cast("timestamp"))


def json_in(answer: Column) -> Column:
    """From the first opening to the last closing brace of an answer; null if it has none."""
    return F.nullif(F.regexp_extract(answer, r"(?s)\{.*\}", 0), F.lit(""))


def truncated(text: Column, most: float, weights: dict[str, float] | None = None, suffix: str = "...") -> Column:
    """The text's first tokens, as many as ``most`` allows by the scores of their classes; a word or number that begins
    within the bound may exceed it by 5 %. Texts within the bound stay; so do those of which nothing would be left."""
    weights = weights or {k: w for k, (w, _) in TEXT_SCORES.items()} | {"other": 0.5}
    classes = "|".join(p for _, p in TEXT_SCORES.values())
    pieces = F.regexp_extract_all(text, F.lit(f"(?s)({classes}|.)"), F.lit(1))
    state = lambda total, length, full: F.struct(total.alias("total"), length.alias("length"), full.alias("full"))

    def add(s: Column, piece: Column) -> Column:
        score = F.lit(float(weights["other"]))
        for k, (_, p) in reversed(TEXT_SCORES.items()):
            score = F.when(F.regexp_like(piece, F.lit(f"^(?:{p})$")), F.lit(float(weights[k]))).otherwise(score)
        total, longer = s["total"] + score, s["length"] + F.length(piece)
        whole = F.regexp_like(piece, F.lit("^([A-Za-z]+|[0-9]+)$")) & (s["total"] > 0) & (total <= most * 1.05)
        return F.when(s["full"], s).when(total <= most, state(total, longer, F.lit(False))).when(whole, state(total, longer, F.lit(True))).otherwise(state(s["total"], s["length"], F.lit(True)))

    end = F.aggregate(pieces, state(F.lit(0.0), F.lit(0), F.lit(False)), add)
    cut = F.regexp_replace(F.left(text, end["length"]), r"\s+$", "")
    return F.when(end["full"] & (end["length"] < F.length(text)) & (cut != ""), F.concat(cut, F.lit(suffix))).otherwise(text)


def relative_dates(text: Column, base: Column) -> Column:
    """Puts the date after phrases like last month, counted from the date base; months are their last day. Phrases with a date
    after them stay, so doing it twice changes nothing. Null base: the text as it is."""
    day = {0: base, 1: F.date_add(base, 1), -1: F.date_add(base, -1), 7: F.date_add(base, 7), -7: F.date_add(base, -7)}
    month = {n: F.last_day(F.add_months(F.trunc(base, "month"), n)) for n in (-1, 0, 1)}
    # fixed values: the phrases and what each means
    phrases = [
        (r"\btoday\b", day[0]), (r"\btomorrow\b", day[1]), (r"\byesterday\b", day[-1]),
        (r"\bthis week\b", day[0]), (r"\blast week\b", day[-7]), (r"\bnext week\b", day[7]),
        (r"\bthis month\b", month[0]), (r"\blast month\b", month[-1]), (r"\bnext month\b", month[1]),
        ("今天", day[0]), ("明天", day[1]), ("昨天", day[-1]), ("本周|这周", day[0]), ("上周", day[-7]), ("下周", day[7]),
        ("本月|这个月", month[0]), ("上个月", month[-1]), ("下个月", month[1]),
    ]
    out = text
    for pattern, when in phrases:
        out = F.regexp_replace(out, F.lit(rf"(?iU)(?:{pattern})(?!\s*[（(]\d{{4}}-\d{{2}}-\d{{2}})"), F.concat(F.lit("$0 ("), F.date_format(when, "yyyy-MM-dd"), F.lit(")")))
    return F.coalesce(out, text)


def mentions(text: Column, refs: Column, sign: str = "@") -> Column:
    """Names after @ become @name(user_id:x). refs: array of struct name, user_id; of one name the first counts. Idempotent. sign="":
    names at the begin of a word, without @."""
    begin = sign or r"(?U)\b"

    def add(t: Column, ref: Column) -> Column:
        shown = F.concat(F.lit(sign), ref["name"], F.lit("(user_id:"), ref["user_id"].cast("string"), F.lit(")"))
        name = F.concat(F.lit(begin + r"\Q"), ref["name"], F.lit(r"\E(?!\(user_id:)"))
        usable = (F.coalesce(ref["name"], F.lit("")) != "") & (F.coalesce(ref["user_id"].cast("string"), F.lit("")) != "")
        return F.when(usable & ~F.contains(t, shown), F.regexp_replace(t, name, F.regexp_replace(shown, r"([\\$])", r"\\$1"))).otherwise(t)

    return F.when(refs.isNull(), text).otherwise(F.aggregate(refs, text, add))


#: Parts of addresses of decorative images.
DECORATIVE = ["icon", "logo", "avatar", "button", "pixel", "spacer", "blank", "transparent", "1x1", "tracking"]


def absolute_url(src: Column, base: Column) -> Column:
    origin, path = F.regexp_extract(base, r"^([a-z]+://[^/?#]+)", 1), F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(path == origin, F.concat(origin, F.lit("/"))).otherwise(F.regexp_replace(path, "[^/]*$", ""))
    return (
        F.when(F.regexp_like(src, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), src)
        .when(src.startswith("//"), F.concat(F.regexp_extract(base, "^([a-z]+:)", 1), src))
        .when(src.startswith("/"), F.concat(origin, src))
        .otherwise(F.concat(folder, src))
    )


def first_image(html: Column, base: Column, least: int = 100) -> Column:
    """Address of the first image that is neither decorative by its address nor known to be smaller than ``least``."""
    attribute = lambda tag, name: F.trim(F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*["']?([^"'>\s]*)""", 1))

    def usable(tag: Column) -> Column:
        src = attribute(tag, "src")
        w, h = (attribute(tag, n).try_cast("int") for n in ("width", "height"))
        small = F.coalesce((w < least) | (h < least), F.lit(False)) & w.isNotNull() & h.isNotNull()
        return (src != "") & ~F.regexp_like(F.lower(src), F.lit("|".join(DECORATIVE))) & ~small

    tag = F.try_element_at(F.filter(F.regexp_extract_all(html, F.lit(r"(?is)(<img\b[^>]*>)"), F.lit(1)), usable), F.lit(1))
    return F.when(tag.isNotNull(), absolute_url(attribute(tag, "src"), base))


def searchable(facts: Column, subject: Column, summary: Column, narrative: Column) -> Column:
    """The facts, where there are any, else the subject three times, the summary twice and the narrative."""
    told = F.nullif(F.array_join(facts, " "), F.lit(""))
    return F.coalesce(told, F.concat_ws(" ", *[subject] * 3, *[summary] * 2, narrative))


def fact_text(time: Column, facts: Column) -> Column:
    """time：facts; one of them alone where the other is missing."""
    part = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws("：", part(time), part(F.array_join(facts, " ")))


def rerank_text(time: Column, facts: Column, narrative: Column) -> Column:
    """What a reranker reads of a document: the time of its facts and the facts, a line each, else the narrative; null without either."""
    lines = F.array_compact(F.concat(F.array(F.nullif(time, F.lit(""))), facts))
    return F.when(F.size(F.coalesce(facts, F.array())) > 0, F.array_join(lines, "\n")).otherwise(F.nullif(narrative, F.lit("")))


def edge_ngrams(text: Column, most: int = 20) -> Column:
    """The lower-case text's first character, its first two, and so on up to ``most``."""
    low = F.lower(text)
    n = F.least(F.length(low), F.lit(most))
    return F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.substr(low, F.lit(1), i))


def lower_keyword(text: Column) -> Column:
    return F.lower(F.trim(text))


def _stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))


def usable_variants(queries: Column, question: Column, most: int = 3) -> Column:
    """Of rewritten queries the first three of 5 to 300 characters that aren't the question itself but for case and outer blanks, trimmed."""
    new = F.filter(queries, lambda q: F.length(q).between(5, 300) & (F.lower(_stripped(q)) != F.lower(_stripped(question))))
    return F.transform(F.slice(new, 1, most), _stripped)


def query_variants(answer: Column, question: Column) -> Column:
    """The usable variants of a model's answer, a JSON object with a list "queries" somewhere in the text; the question itself where the
    answer can't be read or has none."""
    found = usable_variants(F.from_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0), "queries array<string>")["queries"], question)
    return F.when(F.size(F.coalesce(found, F.array())) > 0, found).otherwise(F.array(question))


def short_code(number: Column, least: int = 4, digits: int = 11) -> Column:
    """Base 62, with zeros in front up to ``least`` characters."""
    code = base62(number, digits)
    return F.when(F.length(code) < least, F.lpad(code, least, "0")).otherwise(code)


def unbase62(code: Column) -> Column:
    """The number that a base-62 code stands for; null if it is empty or has other characters."""
    digits = F.split(code, "")
    value = F.aggregate(digits, F.lit(0).cast("decimal(38,0)"), lambda acc, d: (acc * 62 + F.instr(F.lit(BASE62), d) - 1).cast("decimal(38,0)"))
    return F.when(F.regexp_like(code, F.lit("^[0-9a-zA-Z]+$")), value.cast("long"))


def route_whole(key: Column, partitions: int) -> Column:
    """Stable partition 0.. of a key, from all of its md5 read as a number."""
    digit = lambda d: F.instr(F.lit("0123456789abcdef"), d) - 1
    return F.aggregate(F.split(F.md5(key), ""), F.lit(0).cast("long"), lambda acc, d: F.pmod(acc * 16 + digit(d), F.lit(partitions).cast("long")))


def clean_date(shown: Column) -> Column:
    """What is left of a date when all but digits and - is taken away, if that is YYYY-MM-DD; else null."""
    left = F.regexp_replace(shown, r"[^\d\-]", "")
    return F.when(F.regexp_like(left, F.lit(r"^\d{4}-\d{2}-\d{2}$")), left)


def span(start: Column, end: Column, days: Column) -> Column:
    """Struct start, end, days of cleaned dates: a missing end from the days, missing days from the end."""
    a, b = clean_date(start), clean_date(end)
    given = F.coalesce(days, F.lit(0)) != 0
    later = F.date_format(F.date_add(a.try_cast("date"), days.cast("int")), "yyyy-MM-dd")
    between = F.datediff(b.try_cast("date"), a.try_cast("date"))
    return F.struct(a.alias("start"), F.when(a.isNotNull() & given & b.isNull(), later).otherwise(b).alias("end"), F.when(a.isNotNull() & b.isNotNull() & ~given, between).otherwise(days).cast("int").alias("days"))


def fenced_json(answer: Column) -> Column:
    """The JSON of a model's answer: in a block marked json, else in any block, else the whole answer; null if none can be read."""
    marked = F.regexp_extract(answer, r"(?s)```json(.*?)```", 1)
    block = F.regexp_extract(answer, r"(?s)```(?:[A-Za-z]+[^\n]*\n)?(.*?)```", 1)
    readable = lambda t: F.when(F.get_json_object(F.trim(t), "$").isNotNull(), F.trim(t))
    return F.coalesce(readable(marked), readable(block), readable(answer))


def sufficiency(answer: Column) -> Column:
    """Struct is_sufficient, reasoning, missing (array) of a model's answer. What can't be read, or doesn't say, counts as sufficient."""
    found = json_in(answer)
    told = F.get_json_object(found, "$.is_sufficient")
    reason = F.coalesce(F.get_json_object(found, "$.reasoning"), F.lit("No reasoning provided"))
    missing = F.coalesce(F.from_json(F.get_json_object(found, "$.missing_information"), "array<string>"), F.array().cast("array<string>"))
    said = told.isNotNull()
    falsy = F.lower(told).isin("false", "0", "", "null", "[]", "{}")
    return F.struct(
        F.when(said, ~falsy).otherwise(F.lit(True)).alias("is_sufficient"), F.when(said, reason).otherwise("Failed to parse").alias("reasoning"), F.when(said, missing).otherwise(F.array().cast("array<string>")).alias("missing")
    )


_ASSIGNED = "array<struct<type:string,cluster_id:string,new_topic:string>>"


def assignments(answer: Column) -> Column:
    """Array of struct type, cluster_id, new_topic: what an answer decides. It is JSON, or has JSON in it: assignments or, in its older
    form, one decision; else the clusters it names if it says existing, a topic if it says new, and NEW if it says nothing."""
    whole = F.trim(answer)
    found = F.coalesce(F.when(F.get_json_object(whole, "$").isNotNull() & whole.startswith("{"), whole), F.when(F.get_json_object(json_in(answer), "$").isNotNull(), json_in(answer)))
    get = lambda n: F.get_json_object(found, f"$.{n}")
    none = F.array().cast(_ASSIGNED)
    one = lambda kind, cluster, topic: F.array(F.struct(F.lit(kind).alias("type"), cluster.cast("string").alias("cluster_id"), topic.cast("string").alias("new_topic")))
    null, unknown = F.lit(None), F.lit("Unknown topic")
    older = F.when((get("decision") == "EXISTING") & (F.coalesce(get("cluster_id"), F.lit("")) != ""), one("EXISTING", get("cluster_id"), null))
    older = older.when(get("decision") == "NEW", one("NEW", null, F.coalesce(get("new_topic"), unknown))).otherwise(none)
    read = F.when(get("assignments").isNotNull(), F.coalesce(F.from_json(get("assignments"), _ASSIGNED), none)).when(get("decision").isNotNull(), older).otherwise(none)
    upper, names = F.upper(answer), F.regexp_extract_all(answer, F.lit(r"(gec_\d+)"), F.lit(1))
    known = F.when(F.contains(upper, F.lit("EXISTING")), F.transform(names, lambda c: one("EXISTING", c, null)[0])).otherwise(none)
    topic = F.nullif(F.regexp_extract(answer, r'"new_topic":\s*"([^"]+)"', 1), F.lit(""))
    says_new = F.contains(upper, F.lit("NEW"))
    scraped = F.when(says_new & topic.isNotNull(), F.concat(known, one("NEW", null, topic))).when(F.size(known) == 0, one("NEW", null, unknown)).otherwise(known)
    return F.when(found.isNotNull(), read).otherwise(scraped)


def selected_clusters(answer: Column) -> Column:
    """The clusters that an answer selects: of its JSON, of JSON in it, else those it names, each once."""
    of = lambda t: F.from_json(F.get_json_object(t, "$.selected_clusters"), "array<string>")
    inner = F.regexp_extract(answer, r'(?s)\{[^{}]*"selected_clusters"[^{}]*\}', 0)
    return F.coalesce(of(F.trim(answer)), of(inner), F.array_distinct(F.regexp_extract_all(answer, F.lit(r"(gec_\d+)"), F.lit(1))))


#: What a page leaves in a text whose template was not filled.
TEMPLATE = r"\$\{[^}]+\}|\{\{[^}]+\}\}|#\{[^}]+\}|@\{[^}]+\}|\{[a-zA-Z_][a-zA-Z0-9_.]*\}"


def page_metadata(html: Column, url: Column) -> Column:
    """Struct title, description, image, site_name, type, favicon: Open Graph before Twitter before the page's title and meta tags; texts
    with template variables don't count. White space is collapsed, titles are cut at 200 and descriptions at 500 characters; an
    address needs a scheme and a host. Without an icon link the favicon is /favicon.ico."""
    attribute = lambda tag, name: F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*["']([^"']*)["']""", 1)
    head = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    tags = lambda name: F.regexp_extract_all(head, F.lit(rf"(?is)(<{name}\b[^>]*>)"), F.lit(1))
    found = F.struct(tags("meta").alias("metas"), tags("link").alias("links"), F.regexp_extract(head, r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"))
    # a lambda's argument is made once, so the page is searched once
    return F.transform(F.array(found), lambda x: _page_fields(x["metas"], x["links"], x["title"], url, attribute))[0]


def _page_fields(metas: Column, links: Column, page_title: Column, url: Column, attribute) -> Column:
    def safe(value: Column) -> Column:
        text = F.nullif(F.trim(value), F.lit(""))
        return F.when(~F.regexp_like(text, F.lit(TEMPLATE)), text)

    def content(key: str, name: str) -> Column:  # of repeated tags the last counts
        tags = F.filter(metas, lambda t: (attribute(t, key) == name) & (attribute(t, "content") != ""))
        return safe(attribute(F.try_element_at(tags, F.lit(-1)), "content"))

    og, twitter = lambda n: content("property", f"og:{n}"), lambda n: content("name", f"twitter:{n}")
    plain = lambda value: F.nullif(collapsed(value), F.lit(""))
    cut = lambda value, n: F.when(F.length(value) > n, F.concat(F.left(value, F.lit(n)), F.lit("..."))).otherwise(value)
    valid = lambda value: F.when(F.regexp_like(value, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+")), value)
    title = F.coalesce(og("title"), twitter("title"), safe(page_title), content("name", "title"))
    icon = F.try_element_at(F.filter(links, lambda t: F.contains(F.lower(attribute(t, "rel")), F.lit("icon")) & (attribute(t, "href") != "")), F.lit(1))
    favicon = F.coalesce(F.when(icon.isNotNull(), absolute_url(F.trim(attribute(icon, "href")), url)), F.concat(F.regexp_extract(url, r"^([a-z]+://[^/?#]+)", 1), F.lit("/favicon.ico")))
    return F.struct(
        cut(plain(title), 200).alias("title"), cut(plain(F.coalesce(og("description"), twitter("description"), content("name", "description"))), 500).alias("description"),
        valid(plain(F.coalesce(og("image"), twitter("image")))).alias("image"), plain(og("site_name")).alias("site_name"), plain(og("type")).alias("type"), valid(plain(favicon)).alias("favicon"),
    )
