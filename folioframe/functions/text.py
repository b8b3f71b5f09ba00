"""Text expressions: normalisation, answer scores, verdicts, prompts. All native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: prompt texts of the data format
QA_PREFIX = "Answer the question using only the document image(s). Return only the final answer with no explanation."
BBOX_PREFIX = (
    "Locate the region or regions needed to answer the question in each document image. "
    "Return only JSON grouped by page in this format: [[[x1, y1, x2, y2], ...], ...]. "
    "Each outer item corresponds to one input image/page in order. "
    "Each inner item is one bounding box with normalized coordinates between 0 and 1000."
)
JUDGE_TEMPLATE = (
    "Your task is to evaluate whether the model's response correctly answers the question, "
    "based on the provided reference answer.\n"
    "This is part of an automated evaluation process, so your result must be STRICTLY either 'correct' or 'incorrect'.\n"
    "Question: {question}\nReference Answer: {ground_truth}\nModel Response: {response}\n\n"
    "Output only one word: correct or incorrect."
)
CHAT_HEAD, CHAT_TAIL = f"user\n\n{QA_PREFIX}\n", "\nassistant"
IMAGE_TOKEN = "<image>"
MIME_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "bmp": "image/bmp", "gif": "image/gif"}

_BLANK = r"(?U)\s+"


def strip(c: Column) -> Column:
    """Without Unicode blanks at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of blanks become one space, none at the ends; null gives ''."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), _BLANK, " "))


def normalize(c: Column) -> Column:
    return collapse(F.lower(c))


def anls(pred: Column, ref: Column) -> Column:
    """1 - distance / longer length of the normalised texts; 0 from half the length on.

    The distance is cut off where the score is 0 anyway, so long texts stay cheap.
    """
    p, r = normalize(pred), normalize(ref)
    longer = F.greatest(F.length(p), F.length(r))
    distance = F.levenshtein(p, r)
    ratio = distance / longer
    far = F.abs(F.length(p) - F.length(r)) * 2 >= longer
    return (
        F.when((p == "") & (r == ""), 1.0)
        .when((p == "") | (r == ""), 0.0)
        .when(p == r, 1.0)
        .when(far, 0.0)
        .when(ratio >= 0.5, 0.0)
        .otherwise(1.0 - ratio)
    )


def exact_match(pred: Column, ref: Column) -> Column:
    return (normalize(pred) == normalize(ref)).cast("double")


def contains_match(pred: Column, ref: Column) -> Column:
    p, r = normalize(pred), normalize(ref)
    return F.when((p == "") | (r == ""), 0.0).otherwise((F.contains(p, r) | F.contains(r, p)).cast("double"))


def verdict(c: Column) -> Column:
    """'True', 'False', the raw text if neither is said, null for null. The first whole word decides."""
    low = F.lower(strip(c))
    word = F.regexp_extract(low, r"(?U)\b(correct|incorrect|true|false)\b", 1)
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(word.isin("true", "correct"), "True")
        .when(word.isin("false", "incorrect"), "False")
        .when(F.contains(low, F.lit("incorrect")) | F.contains(low, F.lit("false")), "False")
        .when(F.contains(low, F.lit("correct")) | F.contains(low, F.lit("true")), "True")
        .otherwise(c)
    )


def question_of_prompt(prompt: Column) -> Column:
    """The question inside a rendered chat prompt; '' for null."""
    text = strip(F.coalesce(prompt, F.lit("")))
    text = F.when(F.startswith(text, F.lit(CHAT_HEAD)), F.substring(text, len(CHAT_HEAD) + 1, 1 << 30)).otherwise(text)
    cut = F.length(text) - len(CHAT_TAIL)
    return strip(F.when(F.endswith(text, F.lit(CHAT_TAIL)), F.substring(text, F.lit(1), cut)).otherwise(text))


def first_filled(*cols: Column) -> Column:
    """First value that is neither null nor '' ; the last one otherwise."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], cols[-1])


def first_id(*cols: Column) -> Column:
    """First value that is not null and not blank (0 is a value)."""
    return F.coalesce(*[F.when(strip(c.cast("string")) != "", c.cast("string")) for c in cols])


def judge_prompt(question: Column, truth: Column, response: Column) -> Column:
    """The judge's prompt; placeholders are filled one after the other, null reads 'None'."""
    out = F.lit(JUDGE_TEMPLATE)
    for name, c in (("question", question), ("ground_truth", truth), ("response", response)):
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c, F.lit("None")))
    return out


def prompt_prefix(mode: Column, given: str | None = None) -> Column:
    if given is not None:
        return F.lit(given)
    return F.when(mode == "bbox", BBOX_PREFIX).otherwise(QA_PREFIX)


def chat_prompt(query: Column, n_images: Column, prefix: Column) -> Column:
    """One image token per line, then the prefix, then the query."""
    tokens = F.array_repeat(F.lit(IMAGE_TOKEN), n_images.cast("int"))
    lead = F.when(F.length(prefix) > 0, F.array(strip(prefix))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(tokens, lead, F.array(strip(query))), "\n")


def message_of(messages: Column, role: str) -> Column:
    """Content of the first message of a role; null if there is none."""
    return F.get(F.filter(messages, lambda m: m["role"] == role), F.lit(0))["content"]


def prompt_parts(text: Column, images: Column, most: int | None = None) -> Column:
    """Text and image parts in order; image i replaces the i-th token, tokens without an image give none."""
    pieces = F.split(text, IMAGE_TOKEN)
    n = F.least(F.size(pieces) - 1, F.coalesce(F.size(images), F.lit(0)), F.lit(1 << 30 if most is None else most))

    def both(piece: Column, i: Column) -> Column:
        t = F.struct(F.lit("text").alias("type"), piece.alias("value"))
        img = F.struct(F.lit("image").alias("type"), F.get(images, i).alias("value"))
        none = F.array().cast("array<struct<type:string,value:string>>")
        return F.concat(F.when(piece != "", F.array(t)).otherwise(none), F.when(i < n, F.array(img)).otherwise(none))

    return F.flatten(F.transform(pieces, both))


def data_url(path: Column, content: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    mime = F.lit("application/octet-stream")
    for k, v in MIME_TYPES.items():
        mime = F.when(ext == k, v).otherwise(mime)
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.replace(F.base64(content), F.lit("\r\n"), F.lit("")))


def strip_fence(c: Column) -> Column:
    """Without a leading and a trailing code fence."""
    return strip(F.regexp_replace(c, r"(?i)^\s*```(?:json)?\s*|\s*```\s*$", ""))


def strip_fence_lines(c: Column) -> Column:
    """Line-wise: drops the first line if it opens a fence, then the last if it only closes one."""
    text = strip(F.coalesce(c, F.lit("")))
    rest = F.regexp_replace(text, r"^```[^\n]*\n?", "")
    closed = F.regexp_replace(rest, r"(?:^|\n)[ \t]*```[ \t]*$", "")
    return F.when(F.startswith(text, F.lit("```")), strip(closed)).otherwise(text)


def json_span(c: Column) -> Column:
    """From the first [ or { to the last ] or }; null if there is none."""
    return F.nullif(F.regexp_extract(c, r"(?s)[\[{].*[\]}]", 0), F.lit(""))


def braced_block(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*?\}", 0), F.lit(""))


def field_value(line: Column) -> Column:
    """What follows the first ':', else the first '-', else the first full-width colon; else the line."""
    s = strip(line)
    out = s
    for sep in ("：", "-", ":"):
        at = F.locate(sep, s)
        out = F.when(at > 0, strip(F.substring(s, at + 1, F.length(s)))).otherwise(out)
    return out


def is_question_line(line: Column) -> Column:
    return F.lower(strip(line)).rlike(r"(?U)^q(?:uestion)?(?:\b|\d)")


def is_answer_line(line: Column) -> Column:
    return F.lower(strip(line)).rlike(r"(?U)^a(?:nswer)?(?:\b|\d)")


def looks_like_verdict(raw: Column) -> Column:
    """Judge output where question-answer pairs were asked for."""
    return ~F.contains(F.lower(raw), F.lit("qas")) & raw.rlike(r'(?is)"keep"\s*:\s*(true|false)')


def bare_number_key(name: Column) -> Column:
    """All digits of a name as one number; 10^9 without digits."""
    return F.coalesce(F.regexp_replace(name, r"\D", "").try_cast("bigint"), F.lit(10**9).cast("bigint"))


def suffix_page(stem: Column) -> Column:
    """Number after the last underscore; null if it is none."""
    return F.element_at(F.split(stem, "_"), -1).try_cast("bigint")
