"""The text functions as SQL functions of a session, evaluated in the JVM; the fold chunker as a table function (one that
can be joined laterally, which those in Arrow can't)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from docspark.config import Settings

_AR = "\\\\x{0600}-\\\\x{06FF}"
_EDGE = "[\\\\p{L}\\\\p{N}_]"
FUNCTIONS = {
    "is_pdf_url": ("u STRING", "BOOLEAN", "endswith(regexp_replace(split_part(lower(u), '?', 1), '/+$', ''), '.pdf')"),
    "approx_tokens": ("t STRING", "INT", "greatest(1, cast(floor(length(t) / 4) AS INT))"),
    "arabic_share": ("t STRING", "DOUBLE", f"length(regexp_replace(t, '[^{_AR}]', '')) / greatest(length(t), 1)"),
    "page_language": ("t STRING", "STRING", f"CASE WHEN length(regexp_replace(t, '[^{_AR}]', '')) / greatest(length(t), 1) > 0.25 THEN 'ar' ELSE 'en' END"),
    "squeeze": ("t STRING", "STRING", "regexp_replace(regexp_replace(t, '(?U)\\\\s+', ' '), '^ | $', '')"),
    "normalize_question": ("t STRING", "STRING", "lower(regexp_replace(regexp_replace(regexp_replace(coalesce(t, ''), '(?U)\\\\s+', ' '), '^ | $', ''), '[?.!]+$', ''))"),
    "sentence_count": ("t STRING", "INT", "size(filter(split(t, '(?U)(?<=[.!?؟\\\\n])\\\\s+|\\\\n{2,}'), s -> length(regexp_replace(s, '(?U)^\\\\s+|\\\\s+$', '')) > 10))"),
    "is_definition": (
        "q STRING, word STRING", "BOOLEAN",
        "contains(lower(trim(q)), word) AND (lower(trim(q)) = word OR regexp_like(lower(trim(q)), 'what is|define|ما هو|ما هي'))",
    ),
    "word_runs": (
        "w ARRAY<STRING>", "ARRAY<STRING>",
        "filter(zip_with(zip_with(w, slice(w, 2, 1 << 30), (x, y) -> concat(x, ' ', y)), slice(w, 3, 1 << 30), (x, y) -> lower(concat(x, ' ', y))), p -> length(p) > 10)",
    ),
    "phrases_of": ("t STRING", "ARRAY<STRING>", f"word_runs(filter(regexp_extract_all(t, '({_EDGE}+)', 1), w -> regexp_like(w, '^[a-zA-Z{_AR}]{{3,}}$')))"),
    "phrases_matched": ("p ARRAY<STRING>, sources STRING", "INT", "least(5, size(array_distinct(filter(p, x -> contains(sources, x)))))"),
}


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _ruled(settings: Settings) -> dict[str, tuple[str, str, str]]:
    """The functions that the settings' lists make."""
    from docspark.operators.guards import _boundary

    fires = [f"regexp_like(lower(q), {_quoted(_boundary(k.lower()))})" if len(k) <= 20 else f"contains(lower(q), {_quoted(k.lower())})" for k, _ in settings.rules]
    more = "".join(f", CASE WHEN {fire} THEN {_quoted(text)} END" for fire, (_, text) in zip(fires, settings.rules, strict=True))
    words = ", ".join(_quoted(w) for w in settings.generic_words)
    label = "regexp_replace(regexp_replace(coalesce(label, ''), '(?i)\\\\s*\\\\(pdf,?\\\\s*[\\\\d.]+\\\\s*[km]b\\\\)\\\\s*$', ''), '(?U)^\\\\s+|\\\\s+$', '')"
    generic = f"length(l) <= 4 OR forall(regexp_extract_all(lower(l), '([\\\\p{{L}}\\\\p{{N}}]+)', 1), w -> w IN ({words})) OR regexp_like(l, {_quoted('(?i)' + '|'.join(settings.generic_patterns))})"
    return {
        "expand_question": ("q STRING", "STRING", f"concat_ws(' ', q{more})"),
        "out_of_scope": ("q STRING", "BOOLEAN", f"regexp_like(lower(q), {_quoted('(?U)' + '|'.join(settings.out_of_scope))})" if settings.out_of_scope else "false"),
        "link_label": ("label STRING", "STRING", label),
        "is_generic_label": ("l STRING", "BOOLEAN", generic),
        "clean_name": (
            "label STRING, url STRING", "STRING",
            "substring(CASE WHEN is_generic_label(link_label(label)) THEN squeeze(regexp_replace(regexp_replace(regexp_extract(regexp_replace(replace(url, '%20', '_'), '[?#].*$', ''), '([^/]*)$', 1),"
            " '(?<=.)\\\\.[^.]*$', ''), '[_%\\\\-]+', ' ')) ELSE squeeze(link_label(label)) END, 1, 200)",
        ),
    }


def register(spark: SparkSession, settings: Settings = Settings()) -> list[str]:
    """Temporary functions of the session; their names. fold_chunks(text) is a table function: (chunk_no, content, token_count)."""
    functions = FUNCTIONS | _ruled(settings)
    for name, (given, returned, body) in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS {returned} RETURN {body}")

    @udtf(returnType="chunk_no int, content string, token_count int")
    class Fold:
        def eval(self, text: str | None) -> Iterator[tuple[int, str, int]]:
            from docspark.operators.ingest import fold

            for n, (content, tokens) in enumerate(fold(text, settings) if text else [], 1):
                yield n, content, tokens

    spark.udtf.register("fold_chunks", Fold)
    return [*functions, "fold_chunks"]
