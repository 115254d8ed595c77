"""Personal-data queries over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.functions import privacy
from kbspark.plans.registry import query, table
from kbspark.plans.sql import cte, with_ctes

# The SQL engine's expressions have no look-around: the neighbours are captured and put back,
# twice, so that two matches sharing a neighbour are both taken.
_W = r"\p{L}\p{N}_"
_SQL_PATTERNS = {
    "email": (rf"(^|[^{_W}.+-])", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", rf"($|[^{_W}.-])"),
    "se_personnummer": (r"(^|[^\p{Nd}])", r"(?:\p{Nd}{6}[-+]?\p{Nd}{4}|\p{Nd}{8}[-+]?\p{Nd}{4})", r"($|[^\p{Nd}])"),
    "phone": (
        rf"(^|[^{_W}])",
        r"(?:\+?\p{Nd}{1,3}[\s().-]*)?(?:\p{Nd}[\s().-]*){7,14}\p{Nd}",
        rf"($|[^{_W}])",
    ),
    "ip_address": (r"(^|[^\p{Nd}])", r"(?:\p{Nd}{1,3}\.){3}\p{Nd}{1,3}", r"($|[^\p{Nd}])"),
}


def _redact(col: str, category: str) -> str:
    before, core, after = _SQL_PATTERNS[category]
    one = f"'{before}{core}{after}', '\\1{privacy.label(category)}\\2', 'g')"
    return f"regexp_replace(regexp_replace({col}, {one}, {one}"


def _labels(col: str, category: str) -> str:
    mark = privacy.label(category)
    return f"((length({col}) - length(replace({col}, '{mark}', ''))) // {len(mark)})"


_prev = "documents"
for _i, _c in enumerate(privacy.CATEGORIES):
    _src = "text" if _i == 0 else f"t{_i}"
    _cols = "doc_id, lang, source, text" + "".join(f", t{k + 1}" for k in range(_i))
    cte(f"red{_i + 1}", f"SELECT {_cols}, {_redact(_src, _c)} AS t{_i + 1} FROM {_prev}", *([_prev] if _i else []))
    _prev = f"red{_i + 1}"
cte(
    "redacted",
    "SELECT doc_id, lang, source, text, t4 AS redacted, "
    + ", ".join(
        f"({_labels(f't{i + 1}', c)} - {_labels('text' if i == 0 else f't{i}', c)})::BIGINT AS n_{c}"
        for i, c in enumerate(privacy.CATEGORIES)
    )
    + " FROM red4",
    "red4",
)


@query("pii_redact", with_ctes("SELECT doc_id, redacted FROM redacted", "redacted"))
def pii_redact(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return privacy.redact_stages(docs).select("doc_id", "redacted")


_COUNTS = " + ".join(f"n_{c}" for c in privacy.CATEGORIES)


@query(
    "pii_audit",
    with_ctes(
        "SELECT doc_id, " + ", ".join(f"n_{c}" for c in privacy.CATEGORIES) + f""",
        ({_COUNTS})::BIGINT AS transform_count, redacted <> text AS transformed,
        length(text)::BIGINT AS input_chars, length(redacted)::BIGINT AS output_chars FROM redacted""",
        "redacted",
    ),
)
def pii_audit(spark, sf_dir):
    staged = privacy.redact_stages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.col(f"n_{c}") for c in privacy.CATEGORIES]
    return staged.select(
        "doc_id",
        *counts,
        sum(counts[1:], counts[0]).alias("transform_count"),
        (F.col("redacted") != F.col("text")).alias("transformed"),
        F.length("text").cast("long").alias("input_chars"),
        F.length("redacted").cast("long").alias("output_chars"),
    )


def _marked(col: str, category: str) -> str:
    before, core, after = _SQL_PATTERNS[category]
    return f"regexp_replace({col}, '{before}({core}){after}', '\\1' || chr(2) || '\\2' || chr(3) || '\\3', 'g')"


def _tokens(col: str, category: str) -> str:
    """Matches are put between two marks, in two passes since matches may share a neighbour, and then hashed."""
    plain = "split_part(p, chr(2), 1)"
    twice = (
        f"array_to_string(list_transform(string_split({_marked(col, category)}, chr(3)), lambda p: {_marked(plain, category)} || "
        f"CASE WHEN contains(p, chr(2)) THEN chr(2) || split_part(p, chr(2), 2) ELSE '' END), chr(3))"
    )
    value = "split_part(p, chr(3), 1)"
    token = f"'[PII_{category.upper()}_' || left(sha256('salt|{category}|' || {value}), 10) || ']' || substr(p, length({value}) + 2)"
    return f"array_to_string(list_transform(string_split({twice}, chr(2)), lambda p, i: CASE WHEN i = 1 THEN p ELSE {token} END), '')"


_prev = "documents"
for _i, _c in enumerate(privacy.CATEGORIES):
    cte(f"pse{_i + 1}", f"SELECT doc_id, {_tokens('text', _c)} AS text FROM {_prev}", *([_prev] if _i else []))
    _prev = f"pse{_i + 1}"


@query("pii_pseudonymize", with_ctes("SELECT doc_id, text FROM pse4", "pse4"))
def pii_pseudonymize(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", privacy.pseudonymize_column(F.col("text"), "salt").alias("text"))


_REASONS = ", ".join(
    f"CASE WHEN mode <> 'off' AND n_{c} > 0 THEN 'transform.' || mode || '.{c}' END" for c in privacy.CATEGORIES
)


@query(
    "pii_policy",
    with_ctes(
        f"""
        , p AS (SELECT *, CASE lang WHEN 'en' THEN ' Redact ' WHEN 'de' THEN 'off' WHEN 'es' THEN 'Pseudonymize' ELSE 'strict' END AS raw_mode,
                 lang <> 'fr' AS fail_closed, source <> 'src0' AS enabled,
                 CASE WHEN doc_id % 3 = 0 THEN 'ChatGPT' WHEN doc_id % 3 = 1 THEN 'ollama' ELSE 'other' END AS prov FROM redacted),
        r AS (SELECT *, CASE lower(prov) WHEN 'chatgpt' THEN 'chatgpt' ELSE 'ollama' END AS provider,
                 CASE WHEN lower(trim(raw_mode)) IN ('off', 'pseudonymize', 'redact') THEN lower(trim(raw_mode))
                      WHEN fail_closed THEN 'redact' ELSE 'off' END AS configured_mode FROM p),
        m AS (SELECT *, CASE WHEN NOT enabled THEN 'off' ELSE configured_mode END AS mode,
                 CASE WHEN lower(trim(raw_mode)) NOT IN ('off', 'pseudonymize', 'redact')
                      THEN 'enforce.invalid_mode_fallback.' || configured_mode END AS why FROM r)
        SELECT doc_id, provider, configured_mode, mode AS effective_mode,
               CASE mode WHEN 'redact' THEN redacted WHEN 'pseudonymize' THEN pse4.text ELSE m.text END AS output_text,
               concat_ws(',', why, CASE WHEN NOT enabled THEN 'allow.provider_filter_disabled.' || provider END,
                 CASE WHEN enabled AND mode = 'off' THEN 'allow.egress_policy_off' END, {_REASONS},
                 CASE WHEN mode <> 'off' AND {_COUNTS} = 0 THEN 'allow.no_pii_detected' END) AS reason_codes,
               (CASE WHEN mode <> 'off' THEN {_COUNTS} ELSE 0 END)::BIGINT AS transform_count
        FROM m JOIN pse4 USING (doc_id)
        """,
        "redacted",
        "pse4",
    ),
)
def pii_policy(spark, sf_dir):
    lang, source = F.col("lang"), F.col("source")
    texts = table(spark, sf_dir, "documents").select(
        "doc_id",
        "text",
        F.when(lang == "en", " Redact ").when(lang == "de", "off").when(lang == "es", "Pseudonymize").otherwise("strict").alias("mode"),
        (lang != "fr").alias("fail_closed"),
        (source != "src0").alias("provider_enabled"),
        F.when(F.col("doc_id") % 3 == 0, "ChatGPT").when(F.col("doc_id") % 3 == 1, "ollama").otherwise("other").alias(
            "provider"
        ),
    )
    return privacy.apply_policy(texts, "salt").select(
        "doc_id", "provider", "configured_mode", "effective_mode", "output_text", "reason_codes", "transform_count"
    )
