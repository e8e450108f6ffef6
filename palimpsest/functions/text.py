"""Scalar functions over text, entities and times, as column expressions (JVM side only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest import schemas as S

SPACE = r"[ \t\n\r\f\x0B]"
CJK = r"[\x{4e00}-\x{9fff}]"
#: Array of runs of Han characters to array of words.
Segmenter = Callable[[Column], Column]


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def fusion_key(summary: Column) -> Column:
    """The key on which channels meet: the first 60 characters, stripped."""
    return strip(F.substring(summary, 1, 60))


def tokens(text: Column, stop: list[str] | None = None, cjk: bool = False, segment: Segmenter | None = None) -> Column:
    """Lexical tokens: runs of letters, digits and underscores of two characters at least, case kept, without stop words.

    With cjk, runs end where Han characters meet others, and runs of Han characters give their bigrams, or what `segment` makes of the array of
    these runs (an array of words).
    """
    stop = S.STOP_WORDS if stop is None else stop
    if cjk:
        han = F.regexp_extract_all(text, F.lit(CJK + "{2,}"), F.lit(0))
        bigrams = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))
        words = segment(han) if segment else F.flatten(F.transform(han, bigrams))
        runs = F.concat(F.regexp_extract_all(text, F.lit(rf"[\p{{L}}\p{{N}}_&&[^{CJK[1:-1]}]]+"), F.lit(0)), words)
    else:
        runs = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    keep = lambda w: (F.length(w) >= 2) & ~w.isin(stop) if stop else F.length(w) >= 2
    return F.filter(runs, keep)


#: Array of words with their kinds (n..., v..., eng) of a text: array<struct<word:string,kind:string>>.
Tagger = Callable[[Column], Column]


def plain_tagger(text: Column) -> Column:
    """Without a model: Latin identifiers are 'eng', Han bigrams nouns."""
    latin = F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z0-9_-]+"), F.lit(0)), lambda w: F.struct(w.alias("word"), F.lit("eng").alias("kind")))
    han = F.transform(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(CJK + "{2,}"), F.lit(0)), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2))))), lambda w: F.struct(w.alias("word"), F.lit("n").alias("kind")))
    return F.concat(latin, han)


def query_keywords(text: Column, tagger: Tagger = plain_tagger) -> Column:
    """struct(intent, entity): words that say what is asked for (verbs, attributes, privacy words) and whom or what about (nouns, identifiers in lower case)."""
    words = F.filter(tagger(text), lambda w: (strip(w["word"]) != "") & ~w["word"].isin(S.QUERY_STOP_WORDS))
    rooted = lambda w: F.exists(F.array(*map(F.lit, S.ATTRIBUTE_ROOTS)), lambda r: F.contains(w["word"], r))
    wanted = lambda w: (w["kind"] != "eng") & (w["word"].isin(S.PRIVACY_WORDS) | w["word"].isin(S.ATTRIBUTE_NOUNS) | rooted(w) | (w["kind"].startswith("v") & ~w["word"].isin(S.GENERIC_VERBS)))
    intent = F.transform(F.filter(words, wanted), lambda w: w["word"])
    entity = F.transform(F.filter(words, lambda w: (w["kind"] == "eng") | (w["kind"].startswith("n") & ~wanted(w))), lambda w: F.when(w["kind"] == "eng", F.lower(w["word"])).otherwise(w["word"]))
    return F.struct(intent.alias("intent"), entity.alias("entity"))


def grams(text: Column, n: int) -> Column:
    """Distinct substrings of n characters."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def graph_tokens(text: Column) -> Column:
    """Distinct tokens for matching names: words, and windows of two to four Han characters."""
    parts = [F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))]
    parts += [F.regexp_extract_all(text, F.lit(CJK + "{%d}" % n), F.lit(0)) for n in (2, 3, 4)]
    return F.array_sort(F.array_distinct(F.filter(F.concat(*parts), lambda w: F.length(w) >= 2)))


def keyword_hits(text: Column, words: Column, prefix: bool = False) -> Column:
    """How many of the words occur in the text; with prefix, how many first characters do."""
    probe = (lambda w: F.substring(w, 1, 1)) if prefix else (lambda w: w)
    return F.size(F.filter(words, lambda w: F.contains(text, probe(w))))


def _hex_decimal(digest: Column, digits: int) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10)


def triple_text(relations: Column, sep: str) -> Column:
    """Each relation as subject, predicate and object."""
    return F.transform(relations, lambda r: F.concat_ws(sep, F.coalesce(r["subject"], F.lit("")), F.coalesce(r["predicate"], F.lit("")), F.coalesce(r["object"], F.lit(""))))


def fact_fingerprint(entities: Column, relations: Column) -> Column:
    """Entity names and triples, both sorted, so that order never matters; duplicates stay."""
    return F.concat(F.array_join(F.array_sort(entities), "::"), F.lit("||"), F.array_join(F.array_sort(triple_text(relations, "|")), "::"))


def fact_pid(fingerprint: Column) -> Column:
    """Unsigned 64-bit identity as a decimal string."""
    return _hex_decimal(F.md5(F.concat(F.lit("qdrant-v6|"), fingerprint).cast("binary")), 16)


def layer_pid(layer: Column, text: Column, digits: int = 15) -> Column:
    """60-bit identity of an upper-layer record, as a decimal string."""
    return _hex_decimal(F.md5(F.concat(F.lit("4layer|"), layer, F.lit("|"), text).cast("binary")), digits)


def relation_pid(parent: Column, triples: Column) -> Column:
    return F.concat(F.lit("rel_"), F.substring(F.md5(F.concat(parent, F.lit("||"), triples).cast("binary")), 1, 20))


def vector_text(summary: Column, entities: Column, relations: Column) -> Column:
    """What is embedded for a record: summary, entity names and triples."""
    return F.array_join(F.filter(F.concat(F.array(summary), entities, triple_text(relations, " ")), lambda x: x.isNotNull() & (x != "")), " ")


def relation_text(relations: Column) -> Column:
    return F.array_join(triple_text(relations, " "), " ")


def sanitize_predicate(pred: Column) -> Column:
    """Upper case where allowed; anything else, other scripts or white space inside become the fallback."""
    bad = pred.isNull() | (pred == "") | ~pred.rlike(r"^[\x00-\x7F]*$") | strip(pred).rlike(SPACE)
    upper = F.upper(strip(pred))
    return F.when(bad | ~upper.isin(S.PREDICATES), F.lit(S.FALLBACK_PREDICATE)).otherwise(upper)


def sanitize_label(label: Column) -> Column:
    return F.when(label.isin(S.LABELS), label).otherwise(F.lit(S.FALLBACK_LABEL))


def dirty_entity(name: Column, longest: int = 12) -> Column:
    """Empty, too long, or holding a tool word."""
    lower = F.lower(name)
    has_word = F.lit(False)
    for w in sorted({w.lower() for w in S.TOOL_WORDS}):
        has_word = has_word | F.contains(lower, F.lit(w))
    return F.coalesce((strip(name) == "") | (F.length(name) > longest) | has_word, F.lit(True))


def discardable(summary: Column) -> Column:
    """Records not worth keeping: too short, swearing, or filler."""
    s = strip(F.coalesce(summary, F.lit("")))
    return (F.length(s) < 4) | s.rlike(rf"(?U)\b{S.SWEAR_RECORD}\b") | s.rlike(S.VENT)


def vague(summary: Column, concrete: Callable[[Column], Column] | None = None) -> Column:
    """Too short, a stock phrase or, by a given test (a tagger's), without any concrete action."""
    s = strip(F.coalesce(summary, F.lit("")))
    out = F.length(s) < 6
    for p in S.VAGUE:
        out = out | s.rlike(p)
    return out | ~concrete(s) if concrete else out


def graph_filler(summary: Column) -> Column:
    """Generated edge text that reads like a bare triple."""
    parts = F.split(strip(summary), rf"{SPACE}+")
    shouting = F.exists(parts, lambda p: (F.length(p) > 3) & (p == F.upper(p)) & (p != F.lower(p)))
    return (F.length(summary) >= 6) & (F.size(parts) > 3) & ~shouting


def parse_ts(text: Column, offsets: bool = True) -> Column:
    """Timestamp of three plain formats read at +08:00, or (unless strict) of ISO with an offset; else null. The session must be at UTC."""
    plain = [F.try_to_timestamp(text, F.lit(f)) - F.expr("INTERVAL 8 HOURS") for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")]
    return F.coalesce(*plain, *([F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))] if offsets else []))


def source_time(source: Column, file_time: Column, now: Column) -> Column:
    """File time, else a date inside the source name at the day's end, else now (strings)."""
    day = F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d{4}-\d{2}-\d{2})", 1)
    return F.coalesce(file_time, F.when(day != "", F.concat(day, F.lit("T23:59:59+08:00"))), now)


def event_time_defaults(t: Column) -> Column:
    return F.struct(t["start"].alias("start"), t["end"].alias("end"), F.coalesce(t["expression"], F.lit("")).alias("expression"), F.when(F.coalesce(t["precision"], F.lit("")) == "", "unknown").otherwise(t["precision"]).alias("precision"))


def valid_time_defaults(t: Column) -> Column:
    return F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(F.coalesce(t["end_type"], F.lit("")) == "", "open").otherwise(t["end_type"]).alias("end_type"))


def infer_time(summary: Column, now: Column) -> Column:
    """struct(start, expression, precision) from wording: explicit day, recent, today, childhood; null where nothing tells."""
    s = F.coalesce(summary, F.lit(""))
    ymd = r"(\d{4})[-/年](\d{1,2})[-/月](\d{1,2})"
    day = F.concat(F.lpad(F.regexp_extract(s, ymd, 1), 4, "0"), F.lit("-"), F.lpad(F.regexp_extract(s, ymd, 2), 2, "0"), F.lit("-"), F.lpad(F.regexp_extract(s, ymd, 3), 2, "0"), F.lit("T00:00:00+08:00"))
    stamp = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    made = lambda start, expression, precision: F.struct(start.cast("string").alias("start"), F.lit(expression).alias("expression"), F.lit(precision).alias("precision"))
    return (
        F.when(s.rlike(ymd), made(day, "explicit", "day"))
        .when(s.rlike("最近|这两天|前几天|刚"), made(stamp(now - F.expr("INTERVAL 3 DAYS")), "recent", "day"))
        .when(s.rlike("今天|今日"), made(stamp(now), "today", "day"))
        .when(s.rlike("小时候|童年|当年|以前|曾经"), made(F.lit(None), "childhood", "vague"))
    )


def format_memory(summary: Column, event_time: Column, valid_time: Column) -> Column:
    """Summary behind its time tags; empty for an empty summary."""
    said = lambda c: F.when(c != "", c)
    happened = F.coalesce(said(event_time["expression"]), said(event_time["start"]))
    state = F.when(said(valid_time["end"]).isNotNull(), F.concat(F.lit("[状态: 已失效 "), valid_time["end"], F.lit("]"))).when(valid_time["end_type"] == "until_revoked", F.lit("[状态: 至今有效]"))
    out = F.concat_ws(" ", F.when(happened.isNotNull(), F.concat(F.lit("[发生: "), happened, F.lit("]"))), state, summary)
    return F.when(F.coalesce(summary, F.lit("")) == "", F.lit("")).otherwise(out)


def query_hash(text: Column) -> Column:
    return F.md5(strip(text).cast("binary"))


def safe_names(names: Column) -> Column:
    """Without nulls and blanks."""
    return F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda x: x.isNotNull() & (strip(x) != ""))


def scenario_ids(scenario_id: Column, title: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(F.when(scenario_id != "", scenario_id), F.when(title != "", title))))


def agent_id(session_key: Column, channel: Column, sender: Column) -> Column:
    """Who a session belongs to: by channel and sender, else by the shape of the session key."""
    safe = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[^a-zA-Z0-9_.-]", "_")
    channel, sender, key = F.lower(F.coalesce(channel, F.lit(""))), safe(sender), F.coalesce(session_key, F.lit("default"))
    known = (sender != "") & (sender != "_")
    part = lambda n: F.element_at(F.split(key, ":"), n)
    size = F.size(F.split(key, ":"))
    group = lambda p: F.regexp_extract(key, p, 1)
    old_chat, new_chat, old_qq, bot = r"(?i)openclaw-weixin:[^:]*:([^@]+)@im\.wechat", r"(?i)^(?:wechat|weixin):([^:]+)", r"(?i)qqbot:[^:]*:[^:]*:([^:]+)", r"(?i)^([a-z]+)bot:"
    by_key = (
        F.when(key.rlike(old_chat), F.concat(F.lit("wechat_"), safe(group(old_chat))))
        .when(key.rlike(new_chat), F.concat(F.lit("wechat_"), safe(group(new_chat))))
        .when((group(old_qq) != "") & ~group(old_qq).isin("c2c", "guild", "direct"), F.concat(F.lit("qq_"), safe(group(old_qq))))
        .when(key.rlike(bot), F.lower(group(bot)))
        .when(key.startswith("agent:") & (size >= 4) & part(3).isin("qqbot", "openclaw-qqbot"), F.concat(F.lit("qq_"), safe(part(-1))))
        .when(key.startswith("agent:") & (size >= 3) & (F.try_element_at(F.split(key, ":"), F.lit(3)) != "") & (F.try_element_at(F.split(key, ":"), F.lit(3)) != "main"), safe(F.try_element_at(F.split(key, ":"), F.lit(3))))
        .when(key.startswith("agent:") & (F.try_element_at(F.split(key, ":"), F.lit(2)) != ""), safe(F.try_element_at(F.split(key, ":"), F.lit(2))))
        .otherwise(F.lit("default"))
    )
    out = (
        F.when(channel.contains("weixin") | channel.contains("wechat"), F.when(known, F.concat(F.lit("wechat_"), sender)).otherwise("wechat_unknown"))
        .when(channel.contains("qq"), F.when(known, F.concat(F.lit("qq_"), sender)).otherwise("qq_unknown"))
        .when(channel.contains("telegram"), "telegram")
        .when(channel.contains("discord"), "discord")
        .when(key != "default", by_key)
        .otherwise("default")
    )
    return safe(out)


def user_text(event: Column) -> Column:
    """prompt, else content, else userMessage, else the last message of role user."""
    said = lambda c: F.when(strip(c) != "", c)
    return F.coalesce(said(event["prompt"]), said(event["content"]), said(event["userMessage"]), F.try_element_at(F.filter(event["messages"], lambda m: m["role"] == "user"), F.lit(-1))["content"])


def decision_action(reply: Column) -> Column:
    """Action of a model's JSON reply: raw, fenced, or the first object that has one; null where none parses."""
    schema = "action string, reason string"
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    inner = F.regexp_extract(reply, r"(?s)(\{[^{}]*\"action\"[^{}]*\})", 1)
    action = F.upper(F.coalesce(*[F.from_json(c, schema)["action"] for c in (strip(reply), fenced, inner)]))
    return F.when(action.isin("CREATE", "SKIP", "INVALIDATE", "UPDATE", "DISCARD"), action)


def model_backend(model_id: Column, known: list[str]) -> Column:
    prefix = F.split(model_id, "/")[0]
    return F.when(F.contains(model_id, F.lit("/")) & prefix.isin(known), prefix).otherwise("api")
