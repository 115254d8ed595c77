"""Memory policy expressions: types, kinds, routing, slots, expiry, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kbspark.functions import text as tx

# Fixed values.
TYPE_WEIGHT = {"session": 1.0, "working": 0.9, "long_term": 0.8}
TTL_DAYS = {"session": 1, "working": 30}
KINDS = ("semantic", "episodic", "procedural")
PROCEDURAL_HINTS = (
    "how to", "steps", "step by step", "workflow", "run this", "command", "always do", "procedure", "playbook",
    "hur man", "steg", "arbetsflode", "arbetsflöde", "kommando", "alltid", "rutin",
)
EPISODIC_HINTS = (
    "today", "yesterday", "earlier", "last time", "we talked", "i said", "i asked", "meeting", "just now", "idag",
    "igar", "igår", "nyss", "forra", "förra", "mote", "möte", "vi pratade", "jag sa",
)
PROCEDURE_PATTERNS = (r"->", r"\b\d+\.\s+\w+", r"\bif\b.+\bthen\b", r"\bom\b.+\bs[aå]\b")
EPISODE_PATTERNS = (
    r"\b(today|yesterday|idag|ig[aå]r|nyss)\b",
    r"\b(i|we|jag|vi)\s+(said|did|saw|sa|gjorde|sag)\b",
)
SLOT_PATTERNS = (
    r"\bmy\s+([a-z0-9 _-]{2,40})\s+is\s+(.+)$",
    r"\b(?:min|mitt|mina)\s+([a-z0-9åäö _-]{2,40})\s+är\s+(.+)$",
    r"\bdefault\s+([a-z0-9 _-]{2,40})\s*(?:is|=)\s*(.+)$",
)
PREFERENCE_PATTERNS = (r"\bi\s+(?:prefer|like|love)\s+(.+)$", r"\bjag\s+(?:föredrar|gillar|älskar)\s+(.+)$")
REMEMBER = r"^\s*(?:remember(?:\s+this|\s+that)?|kom\s+ih[åa]g(?:\s+(?:detta|det\s+h[aä]r))?)\s*(.*)$"
KIND_PREFIX = r"^(?:as\s+)?(semantic|episodic|procedural)\s*[:\-]?\s+(.+)$"
CONTEXT_HINTS = (
    "status", "continue", "context", "handoff", "next", "nasta", "roadmap", "focus", "working on",
    "what are we doing",
)


def memory_type(value: Column) -> Column:
    clean = F.lower(tx.strip(F.coalesce(value, F.lit(""))))
    return F.when(clean.isin(*TYPE_WEIGHT), clean).otherwise("working")


def memory_kind(value: Column, default: Column | None = None) -> Column:
    clean = F.lower(tx.strip(F.coalesce(value, F.lit(""))))
    known = F.when(clean.isin(*KINDS), clean)
    return known if default is None else F.coalesce(known, default)


def type_weight(kind: Column) -> Column:
    return (
        F.when(kind == "session", TYPE_WEIGHT["session"])
        .when(kind == "long_term", TYPE_WEIGHT["long_term"])
        .otherwise(TYPE_WEIGHT["working"])
    )


def hint_count(lower: Column, hints: tuple[str, ...]) -> Column:
    """Number of hints contained in the text."""
    return F.size(F.filter(F.array(*[F.lit(h) for h in hints]), lambda h: F.contains(lower, h)))


def matches_any(lower: Column, patterns: tuple[str, ...]) -> Column:
    return lower.rlike("(?U)(?:" + "|".join(patterns) + ")")


def route(text: Column, type_hint: Column, preferred: Column) -> Column:
    """Struct of kind, reason and confidence for a normalised text; the reasons and confidences are fixed values."""

    def scores(lower: Column) -> Column:
        bonus = lambda patterns: F.when(matches_any(lower, patterns), 2).otherwise(0)
        return F.struct(
            (hint_count(lower, PROCEDURAL_HINTS) + bonus(PROCEDURE_PATTERNS)).alias("procedural"),
            (hint_count(lower, EPISODIC_HINTS) + bonus(EPISODE_PATTERNS)).alias("episodic"),
            memory_kind(preferred).alias("forced"),
        )

    def outcome(kind: Column, reason: str, confidence: float) -> Column:
        return F.struct(
            kind.alias("memory_kind"), F.lit(reason).alias("reason"), F.lit(confidence).alias("confidence")
        )

    def decide(s: Column) -> Column:
        return (
            F.when(s["forced"].isNotNull(), outcome(s["forced"], "forced_kind", 0.95))
            .when(
                F.lower(tx.strip(F.coalesce(type_hint, F.lit("")))) == "session",
                outcome(F.lit("episodic"), "memory_type_hint=session", 0.92),
            )
            .when(
                s["procedural"] >= F.greatest(F.lit(2), s["episodic"] + 1),
                outcome(F.lit("procedural"), "procedural_hints", 0.82),
            )
            .when(s["episodic"] >= 2, outcome(F.lit("episodic"), "episodic_hints", 0.82))
            .otherwise(outcome(F.lit("semantic"), "default_semantic", 0.70))
        )

    return tx.let(tx.let(F.lower(text), scores), decide)


def normalize_slot(raw: Column) -> Column:
    slot = F.translate(F.lower(tx.cut(tx.collapse_space(raw), 60)), "åäö", "aao")
    slot = F.regexp_replace(F.regexp_replace(slot, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.regexp_replace(F.substring(slot, 1, 48), "_+$", "")


def normalize_value(raw: Column) -> Column:
    value = tx.cut(tx.collapse_space(raw), 280)
    return F.regexp_replace(value, r"^[ \t\r\n.,;:]+|[ \t\r\n.,;:]+$", "")


def slot_and_value(text: Column) -> Column:
    """Struct (slot, value) of the first pattern that yields both, null when none does."""
    extract = lambda pattern, group: F.regexp_extract(text, f"(?iU){pattern}", group)
    found = [F.struct(extract(p, 1).alias("slot"), extract(p, 2).alias("value")) for p in SLOT_PATTERNS]
    found += [F.struct(F.lit("preference").alias("slot"), extract(p, 1).alias("value")) for p in PREFERENCE_PATTERNS]
    clean = F.transform(
        F.array(*found),
        lambda s: F.struct(normalize_slot(s["slot"]).alias("slot"), normalize_value(s["value"]).alias("value")),
    )
    return F.get(F.filter(clean, lambda s: (s["slot"] != "") & (s["value"] != "")), F.lit(0))


REMEMBER_CHARS = (2400, 2000, 1800)  # fixed values: of the question, of what is to be remembered, and after a kind


def explicit_remember(question: Column, limits: tuple[int | None, int | None, int | None] = REMEMBER_CHARS) -> Column:
    """Struct (is_command, text, memory_kind) of a spoken "remember" request; a limit of None cuts nothing."""
    short = lambda value, limit: value if limit is None else tx.cut(value, limit)

    def parsed(text: Column) -> Column:
        rest = F.regexp_replace(
            short(tx.collapse_space(F.regexp_extract(text, f"(?isU){REMEMBER}", 1)), limits[1]), "^[: -]+", ""
        )
        is_command = text.rlike(f"(?isU){REMEMBER}")
        body = F.regexp_extract(rest, f"(?isU){KIND_PREFIX}", 2)
        has_kind = body != ""
        return F.struct(
            is_command.alias("is_command"),
            F.when(is_command, F.when(has_kind, short(tx.collapse_space(body), limits[2])).otherwise(rest)).alias("text"),
            F.when(
                is_command & has_kind, F.lower(F.regexp_extract(rest, f"(?isU){KIND_PREFIX}", 1))
            ).alias("memory_kind"),
        )

    return tx.let(short(tx.clean_space(question), limits[0]), parsed)


def default_expiry(kind: Column, created: Column) -> Column:
    day = lambda n: F.timestamp_add("DAY", F.lit(n), created)
    return F.when(kind == "session", day(TTL_DAYS["session"])).when(kind == "working", day(TTL_DAYS["working"]))


def parse_time(value: Column) -> Column:
    """Lenient timestamp in UTC, null when unreadable; a time without a zone is taken as UTC."""
    clean = tx.strip(value)
    zoned = clean.rlike(r":\d{2}(?:\.\d+)?\s*(?:Z|[+-]\d{2}:?\d{2})$")
    # A zoned time is an instant; the session's own zone drops out again.
    instant = F.convert_timezone(F.current_timezone(), F.lit("UTC"), clean.try_cast("timestamp").cast("timestamp_ntz"))
    return F.when(zoned, instant).otherwise(clean.try_cast("timestamp_ntz"))


def days_between(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(86_400_000_000.0)


def recency(created: Column, as_of: Column, half_life_days: float = 14.0) -> Column:
    age = F.greatest(F.lit(0.0), days_between(as_of, created))
    return F.coalesce(F.lit(1.0) / (F.lit(1.0) + age / half_life_days), F.lit(0.3))


def decay(created: Column, as_of: Column, half_life_hours: float = 96.0) -> Column:
    if half_life_hours <= 0:
        return F.lit(1.0)
    age = F.greatest(F.lit(0.0), days_between(as_of, created) * 24.0)
    return F.coalesce(F.pow(F.lit(0.5), age / half_life_hours), F.lit(1.0))


def is_context_question(text: Column) -> Column:
    lower = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for hint in CONTEXT_HINTS:
        out = out | lower.contains(hint)
    return out
