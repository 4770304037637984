r"""Chat formatting with typed content parts (JVM only).

A turn's content is a list of typed parts: text, image, audio or document.  A
visitor, one handler a type, flattens the list in order: text becomes its
escaped form, an attachment becomes the placeholder of its type and leaves a
reference (ordinal in the conversation, turn, type, ref, raw source) with the
number of tokens the placeholder expands to.  A plain text column is read as parts by
``parts_of``: markdown attachments ``![caption](ref)`` are told apart by the file
ending of their ref (another ending: image), all else is text.

Template: each turn is ``<|turn|>`` role ``<|says|>`` body ``<|end|>``.  Control
strings inside roles and texts - any ``<|``, and the marks of other
templates in ``CONTROLS`` - get ``\:`` after their first character and every
backslash is doubled, so no control string is left and ``unescaped`` gives
the text back.  The loss mask is a flag per segment: a conversation is an array of
segments (text, loss) whose texts in order are the formatted string; only the
bodies of assistant turns are under the loss.

Rows are ordered by turn (nulls first), then role and text; repeated rows are
turns like any other.  A null text is empty, a null role is an empty role, a
null conv_id is a conversation of its own.  Texts of any length are taken
whole.  No rows: empty result.  Other columns are ignored.  A conversation is one row of
the result, so its turns meet in one task; nothing else does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from comparo.llm.common import table

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: Control strings of common chat templates that texts may hold; ``<|`` opens those of the template itself.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>")
#: File endings by part type.
ENDINGS = {"audio": ("mp3", "wav", "flac", "ogg", "m4a"), "document": ("pdf", "doc", "docx", "odt", "txt", "html", "csv", "xlsx", "pptx")}
#: Markdown attachment; each scan ends at the next bracket, so any text is read in linear time.
ATTACHMENT = r"!\[[^\[\]\n]*\]\([^()\x00-\x20]+\)"
PART = "struct<type:string,text:string,ref:string,source:string,width:int,height:int,seconds:double,pages:int>"
#: Tokens a placeholder expands to: image tiles of 28 x 28 pixels, audio frames a second, tokens a page; and when the size is unknown.
TILE, FRAMES, PAGE = 28, 25, 800
UNKNOWN = {"image": 1024, "audio": 750, "document": 1600}


def _quoted(s: str) -> str:
    return "".join("\\" + c if c in "\\[](){}.*+?^$|/" else c for c in s)


_STARTS = "|".join(f"{_quoted(c[0])}(?={_quoted(c[1:])})" for c in CONTROLS)


def escaped(text: Column) -> Column:
    """Text without control strings, from which ``unescaped`` gives the text back."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _STARTS, "$0\\\\:")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?:(\\)|:)", "$1")


def parts_of(text: Column) -> Column:
    """Typed parts of a plain text; joined sources are the text itself."""
    literals = F.split(text, ATTACHMENT, -1)
    found = F.concat(F.regexp_extract_all(text, F.lit(ATTACHMENT), F.lit(0)), F.array(F.lit(None).cast("string")))
    ref = lambda s: F.regexp_extract(s, r"\]\((.*)\)$", 1)
    ending = lambda s: F.lower(F.regexp_extract(s, r"\.([A-Za-z0-9]+)\)$", 1))

    def kind(s):
        return F.when(ending(s).isin(*ENDINGS["audio"]), "audio").when(ending(s).isin(*ENDINGS["document"]), "document").otherwise("image")

    def part(type_, text_, ref_, source):
        return F.struct(type_.alias("type"), text_.alias("text"), ref_.alias("ref"), source.alias("source"), F.lit(None).cast("int").alias("width"),
                        F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")).cast(PART)

    none = F.lit(None).cast("string")
    pairs = F.zip_with(literals, found, lambda t, s: F.array(part(F.lit("text"), t, none, t), part(kind(s), none, ref(s), s)))
    return F.filter(F.flatten(pairs), lambda p: p["source"].isNotNull() & ((p["type"] != "text") | (p["text"] != "")))


#: The visitor: what a part of each type leaves in the body, and the tokens it stands for.
def _placeholder(kind: str) -> str:
    return f"<|{kind}|>"


VISIT = {
    "text": lambda p: (escaped(F.coalesce(p["text"], F.lit(""))), F.lit(0)),
    "image": lambda p: (F.lit(_placeholder("image")), F.ceil(p["width"] / TILE) * F.ceil(p["height"] / TILE)),
    "audio": lambda p: (F.lit(_placeholder("audio")), F.ceil(p["seconds"] * FRAMES)),
    "document": lambda p: (F.lit(_placeholder("document")), p["pages"] * PAGE),
}
ATTACHED = tuple(k for k in VISIT if k != "text")
PLACEHOLDER = r"<\|(?:" + "|".join(ATTACHED) + r")\|>"


def body(parts: Column) -> Column:
    """The flattened parts, in order; a part of an unknown or null type is read as text."""
    def visit(p):
        out = VISIT["text"](p)[0]
        for kind in ATTACHED:
            out = F.when(p["type"] == kind, VISIT[kind](p)[0]).otherwise(out)
        return out
    return F.array_join(F.transform(parts, visit), "")


def attachments(parts: Column) -> Column:
    """type, ref, source and expanded tokens of the parts that are not text, in order."""
    def one(p):
        tokens = F.lit(None).cast("long")
        for kind in ATTACHED:
            tokens = F.when(p["type"] == kind, F.coalesce(VISIT[kind](p)[1].cast("long"), F.lit(UNKNOWN[kind]))).otherwise(tokens)
        return F.struct(p["type"].alias("type"), p["ref"].alias("ref"), p["source"].alias("source"), tokens.cast("long").alias("tokens"))
    return F.transform(F.filter(parts, lambda p: p["type"].isin(*ATTACHED)), one)


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, segments (array of text, loss), attachments (array of ordinal, turn, type, ref, source, tokens).

    ``turns``: conv_id, turn, role, and ``parts`` (array of PART) or else ``text``.
    """
    parts = F.col("parts").cast(f"array<{PART}>") if "parts" in turns.columns else parts_of(F.coalesce("text", F.lit("")))
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce(parts, F.array().cast(f"array<{PART}>")).alias("parts"))
    whole = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", body(F.col("parts")).alias("body"), attachments(F.col("parts")).alias("found")))).alias("ts"))

    def segments(x):
        return F.array(F.struct(F.concat(F.lit(TURN), escaped(x["role"]), F.lit(SAYS)).alias("text"), F.lit(False).alias("loss")),
                       F.struct(x["body"].alias("text"), (x["role"] == "assistant").alias("loss")),
                       F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")))

    each = F.flatten(F.transform("ts", lambda x: F.transform(x["found"], lambda a: F.struct(x["turn"].alias("turn"), a.alias("a")))))
    return whole.select("conv_id", F.flatten(F.transform("ts", segments)).alias("segments"), F.transform(each, lambda a, i: F.struct(
        i.alias("ordinal"), a["turn"].alias("turn"), a["a"]["type"].alias("type"), a["a"]["ref"].alias("ref"), a["a"]["source"].alias("source"), a["a"]["tokens"].alias("tokens"))).alias("attachments"))


def text_of(segments: Column) -> Column:
    """The formatted string."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def inlined(text: Column, found: Column) -> Column:
    """A formatted string with its placeholders replaced by the (escaped) sources of ``found``, in order."""
    rest = F.concat(F.transform(found, lambda a: escaped(F.coalesce(a["source"], F.lit("")))), F.array(F.lit("")))
    return F.array_join(F.flatten(F.zip_with(F.split(text, PLACEHOLDER, -1), rest, lambda t, a: F.array(t, F.coalesce(a, F.lit(""))))), "")


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text), loss (text under the mask), formatted: all from segments and attachments."""
    # one mark between segments that cannot occur inside them (any "<|" of a text is escaped)
    mark = "<|segment|>"
    joined = inlined(F.array_join(F.transform("segments", lambda s: s["text"]), mark), F.col("attachments"))
    flat = F.split(joined, _quoted(mark), -1)
    plain = F.zip_with(flat, F.transform("segments", lambda s: s["loss"]), lambda t, m: F.when(m, unescaped(t)))
    c = chats.select("conv_id", text_of(F.col("segments")).alias("formatted"), F.array_join(F.filter(plain, lambda x: x.isNotNull()), "").alias("loss"), inlined(text_of(F.col("segments")), F.col("attachments")).alias("whole"))
    opened = F.filter(F.split("whole", _quoted(TURN), -1), lambda x, i: i > 0)
    halves = F.transform(opened, lambda x: F.split(x, _quoted(SAYS) + "|" + _quoted(END), -1))
    turns = F.transform(halves, lambda h: F.struct(unescaped(h[0]).alias("role"), unescaped(h[1]).alias("text")))
    return c.select("conv_id", turns.alias("turns"), "loss", "formatted")


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -7: control strings said by both sides."""
    said = "</s>[INST] ok [/INST]"
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    chats = formatted(given.unionByName(probe(spark)))
    r = read_back(chats)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return r.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
                    F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def _times(c: str) -> str:
    q = c.replace("'", "''")
    return f"(length(t) - length(replace(t, '{q}', ''))) // {len(c)}"


_MD = "'!\\[[^\\[\\]\\n]*\\]\\([^()\\x00-\\x20]+\\)'"
OP13_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
found AS (SELECT *, regexp_extract_all(text, {_MD}) AS md, regexp_replace(text, {_MD}, 'X', 'g') AS rest FROM c),
sized AS (
  SELECT *, list_sum(list_transform([role, rest], lambda t: length(t) + {_times(chr(92))} + 2 * ({' + '.join(_times(c) for c in CONTROLS)}))) - len(md)
    + coalesce(list_sum(list_transform(md, lambda m: CASE WHEN lower(regexp_extract(m, '\\.([A-Za-z0-9]+)\\)$', 1)) IN ({', '.join(f"'{e}'" for e in ENDINGS['audio'])}) THEN {len(_placeholder('audio'))}
        WHEN lower(regexp_extract(m, '\\.([A-Za-z0-9]+)\\)$', 1)) IN ({', '.join(f"'{e}'" for e in ENDINGS['document'])}) THEN {len(_placeholder('document'))} ELSE {len(_placeholder('image'))} END)), 0)
    + {len(TURN + SAYS + END)} AS n
  FROM found)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
