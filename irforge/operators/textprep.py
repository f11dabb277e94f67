"""Projections, filters and predicates on texts (P1-P16, W6, F9) as Column/DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from irforge.functions import fixed
from irforge.functions.text import after_last, before_first, cut_at_each, first_tokens, is_ascii, py_rstrip, py_strip


def merge_title_text(title: Column, text: Column) -> Column:
    """strip(title + ' ' + text) when the stripped title is non-empty, else the stripped text."""
    t, x = py_strip(F.coalesce(title, F.lit(""))), py_strip(F.coalesce(text, F.lit("")))
    return F.when(t != "", py_strip(F.concat_ws(" ", t, x))).otherwise(x)


def min_chars_rule(dataset: Column, rule: dict[str, int], default: int | None) -> Column:
    """Minimum length by dataset name; ``default`` for names not in ``rule`` (None = no minimum)."""
    expr = None
    for name, n in rule.items():
        expr = (F.when(dataset == name, F.lit(n)) if expr is None else expr.when(dataset == name, F.lit(n)))
    dflt = F.lit(default if default is not None else 0)
    return dflt if expr is None else expr.otherwise(dflt)


def filter_len_sampling(docs: DataFrame, dataset: Column, text_col: str = "doctext") -> DataFrame:
    """Drop documents shorter than the dataset's minimum (special names, else 300)."""
    m = min_chars_rule(dataset, fixed.SAMPLING_MIN_CHARS, fixed.DEFAULT_MIN_CHARS)
    return docs.where(F.length(F.col(text_col)) >= m)


def filter_len_kselect(docs: DataFrame, dataset: Column, text_col: str = "doctext") -> DataFrame:
    """The K-selection rule: dataset minimum first, then 300 for every dataset (so 300 wins)."""
    m = min_chars_rule(dataset, fixed.KSELECT_MIN_CHARS, None)
    n = F.length(F.col(text_col))
    return docs.where((n >= m) & (n >= fixed.DEFAULT_MIN_CHARS))


def truncate_tokens(text: Column, n: int = fixed.TRUNCATE_TOKENS) -> Column:
    """First n whitespace tokens joined by one space."""
    return first_tokens(text, n)


def text_prefix(text: Column, n: int) -> Column:
    """P5: first n characters."""
    return F.substring(text, 1, n)


def clean_question(q: Column) -> Column:
    """Delete newlines (no space), rstrip, cut at each stop phrase in order, strip."""
    x = py_rstrip(F.replace(q, F.lit("\n"), F.lit("")))
    return py_strip(cut_at_each(x, fixed.QUESTION_STOP_PHRASES))


def keep_question(cleaned: Column) -> Column:
    """Non-empty and ASCII only."""
    return (cleaned != "") & is_ascii(cleaned)


def clean_llm_output(output: Column, prompt: Column) -> Column:
    """Remove the prompt text, then successively keep the part before each cut, stripping each time."""
    x = py_strip(before_first(F.replace(output, prompt, F.lit("")), fixed.LLM_OUTPUT_CUTS[0]))
    return cut_at_each(x, fixed.LLM_OUTPUT_CUTS[1:], strip_each=True)


def extract_question(output: Column) -> Column:
    """Text after the last 'Query:', first line, stripped, '?' appended when missing."""
    q = py_strip(before_first(py_strip(after_last(output, "Query:")), "\n"))
    return F.when(q.endswith("?"), q).otherwise(F.concat(q, F.lit("?")))


def render_fewshot_prompt(passage: Column, exemplars: list[tuple[str, str]]) -> Column:
    """P10: instruction + 'Example i' blocks + the new passage."""
    blocks = "\n\n".join(fixed.FEWSHOT_EXAMPLE_FORMAT.format(i=i + 1, passage=p, query=q) for i, (p, q) in enumerate(exemplars))
    head, tail = fixed.FEWSHOT_TAIL.split("{passage}")
    return F.concat(F.lit(fixed.FEWSHOT_INSTRUCTION + blocks + head), passage, F.lit(tail))


def render_template_prompt(template: str, document: Column) -> Column:
    """``template.format(document=doc, query='').rstrip()`` (braces other than the two fields kept)."""
    pre, post = template.split("{document}", 1)
    post = post.replace("{query}", "")
    return py_rstrip(F.concat(F.lit(pre.replace("{query}", "")), document, F.lit(post)))


def render_rerank_prompt(query: Column, doc: Column, with_suffix: bool = True) -> Column:
    """P12: 'Query: {q} Document: {d} Relevant:' (training) or without the suffix (test input)."""
    base = F.concat(F.lit("Query: "), query, F.lit(" Document: "), doc)
    return F.concat(base, F.lit(" " + fixed.RERANK_SUFFIX)) if with_suffix else base


def label_to_token(label: Column) -> Column:
    """P13."""
    return F.when(label == 1.0, F.lit(fixed.RERANK_TRUE)).otherwise(F.lit(fixed.RERANK_FALSE))


def doc_text_join_fields(title: Column, text: Column, multifield: bool = True, sep: str = ". ") -> Column:
    """Title + sep + text for multifield indexes, else text only."""
    return F.concat(title, F.lit(sep), text) if multifield else text


def present_text(text: Column, allow_empty: bool = False) -> Column:
    """Looked-up text is present (and, unless ``allow_empty``, non-empty)."""
    return text.isNotNull() if allow_empty else (text.isNotNull() & (text != ""))


def question_from_terms(terms: Column) -> Column:
    """question template from an array of terms (first two used)."""
    n = F.size(terms)
    two = F.format_string(fixed.QUESTION_TWO_TERMS.replace("{t0}", "%s").replace("{t1}", "%s"),
                          F.element_at(terms, 1), F.element_at(terms, F.least(n, F.lit(2))))
    one = F.format_string(fixed.QUESTION_ONE_TERM.replace("{t0}", "%s"), F.element_at(terms, 1))
    return F.when(n >= 2, two).when(n == 1, one).otherwise(F.lit(fixed.QUESTION_NO_TERM))


def latest_per_key(df: DataFrame, key: str, seq: str) -> DataFrame:
    """One row per key, the one with the highest ``seq`` (later rows overwrite earlier ones)."""
    cols = [c for c in df.columns if c != key]
    packed = df.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(seq)).alias("__r"))
    return packed.select(key, "__r.*")


def cleaned_questions(questions: DataFrame) -> DataFrame:
    """P6 + P7 + W6: (docid, question, doctext) with one accepted question per docid."""
    c = questions.withColumn("question", clean_question(F.col("question")))
    kept = c.where(keep_question(F.col("question")))
    return latest_per_key(kept, "docid", "seq")
