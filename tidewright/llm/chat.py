r"""Chat formatting with DataFrame functions only.

Turns are collected as structs, sorted, adjacent turns of one role are merged into a block,
and blocks are concatenated:

    <|turn|>role<|text|>text[<|more|>text ...]<|end|>\n

Control strings inside roles and texts get a backslash after their first character
(one more if they have some), so they can be read back exactly and no text can open or close
a turn. ``loss_spans`` are the code points of the texts of assistant turns in the formatted text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import let

#: The marks of this template, and control strings of common ones that are escaped likewise.
TURN, TEXT, MORE, END = "<|turn|>", "<|text|>", "<|more|>", "<|end|>\n"
CONTROL_TAIL = r"(\||/?s>|/?INST\]|<SYS>|<?/SYS>)"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL_TAIL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL_TAIL, "$1$2$3")


def _blocks(turns: Column) -> Column:
    """Sorted turns as an array of arrays, one for each run of one role; linear in the turns."""
    last = F.size(turns) - 1

    def cut(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, i - 1)["role"]))
        return let(starts, lambda s: F.transform(s, lambda a, k: F.slice(t, a + 1, F.coalesce(F.get(s, k + 1), F.size(t)) - a)))

    return F.when(last >= 0, cut(turns))


def _chunked(x: Column) -> Column:
    """An array in chunks of the root of its size."""
    step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x)))).cast("int")
    return F.when(F.size(x) > 0, let(step, lambda c: F.transform(F.sequence(F.lit(1), F.size(x), c), lambda s: F.slice(x, s, c)))).otherwise(F.array(x))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text of formatted under a loss mask (spans of begin and length), unescaped, in order, nothing between.

    A place inside a text is found by walking it, so spans are taken out of the piece of text that a chunk of them covers.
    """
    cut = lambda text, begin, length: F.substring(text, (begin + 1).cast("int"), length.cast("int"))

    def texts(chunk: Column) -> Column:
        first, last = F.get(chunk, F.lit(0)), F.get(chunk, F.size(chunk) - 1)
        piece = cut(formatted, first["begin"], last["begin"] + last["length"] - first["begin"])
        return let(piece, lambda p: F.array_join(F.transform(chunk, lambda s: unescape(cut(p, s["begin"] - first["begin"], s["length"]))), ""))

    return F.when(F.size(spans) > 0, F.array_join(F.transform(_chunked(spans), texts), "")).otherwise(F.lit(""))


def _spans(turns: Column) -> Column:
    """Begin and length of the loss texts in the formatted text of sorted turns (role, marked: the escaped role, text: the escaped text).

    Places are sums of sizes before. They are summed in chunks of the root of the number of turns, since an array that
    grows by one is copied each time.
    """

    def sizes(t: Column) -> Column:
        def size(x: Column, i: Column) -> Column:
            first = (i == 0) | (F.get(t, i - 1)["role"] != x["role"])
            head = F.when(first, F.length(x["marked"]) + len(TURN) + len(TEXT) + F.when(i > 0, len(END)).otherwise(0)).otherwise(len(MORE))
            return F.struct(head.cast("long").alias("head"), F.length(x["text"]).cast("long").alias("n"), (x["role"] == LOSS_ROLE).alias("loss"))

        return F.transform(t, size)

    def placed(chunks: Column) -> Column:
        total = lambda chunk: F.aggregate(chunk, F.lit(0).cast("long"), lambda a, x: a + x["head"] + x["n"])
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("found"))
        begins = F.aggregate(F.transform(chunks, total), start, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["found"], F.array(a["at"])).alias("found")))["found"]

        def spans(chunk: Column, begin: Column) -> Column:
            start = F.struct(begin.alias("at"), F.array().cast("array<struct<begin:bigint,length:bigint>>").alias("found"))
            grown = lambda a, x: F.when(x["loss"], F.concat(a["found"], F.array(F.struct((a["at"] + x["head"]).alias("begin"), x["n"].alias("length"))))).otherwise(a["found"])
            return F.aggregate(chunk, start, lambda a, x: F.struct((a["at"] + x["head"] + x["n"]).alias("at"), grown(a, x).alias("found")))["found"]

        return let(begins, lambda b: F.flatten(F.transform(chunks, lambda chunk, k: spans(chunk, F.get(b, k)))))

    return let(sizes(turns), lambda x: let(_chunked(x), placed))


def format_chats(chats: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation: id, formatted, loss_spans (array of begin, length), n_blocks.

    Rows are ordered by turn (null first), then role, then text, so ties have one result and repeated rows stay.
    Null text and null role count as empty; rows of a null id are one conversation; an empty table gives no row. Other
    columns are not looked at. A conversation is one output value, so its rows meet in one task; that is bounded by the longest conversation.
    """
    empty = F.lit("")
    turns = chats.select(F.col(id_col).alias("id"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), empty).alias("role"), F.coalesce(F.col(text_col), empty).alias("text")).alias("t")).groupBy("id").agg(F.collect_list("t").alias("turns"))

    def whole(blocks: Column) -> Column:
        piece = lambda b: F.concat(F.lit(TURN), F.get(b, F.lit(0))["marked"], F.lit(TEXT), F.array_join(F.transform(b, lambda x: x["text"]), MORE), F.lit(END))
        return F.array_join(F.transform(blocks, piece), "")

    def built(turns: Column) -> Column:
        marked = F.transform(turns, lambda x: F.struct(x["role"].alias("role"), escape(x["role"]).alias("marked"), escape(x["text"]).alias("text")))
        return let(marked, lambda t: let(_blocks(t), lambda b: F.struct(whole(b).alias("formatted"), _spans(t).alias("loss_spans"), F.size(b).cast("long").alias("n_blocks"))))

    return turns.select(F.col("id").alias(id_col), built(F.array_sort("turns")).alias("r")).select(id_col, "r.formatted", "r.loss_spans", "r.n_blocks")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""

    def block(b: Column) -> Column:
        parts = F.split(F.substring(b, F.lit(len(TURN) + 1), F.length(b)), r"<\|text\|>", 2)
        return let(parts, lambda p: F.transform(F.split(F.get(p, F.lit(1)), r"<\|more\|>", -1), lambda x: F.struct(unescape(F.get(p, F.lit(0))).alias("role"), unescape(x).alias("text"))))

    return F.flatten(F.transform(F.filter(F.split(formatted, r"<\|end\|>\n", -1), lambda b: b != ""), block))


def chat_digests(chats: DataFrame) -> DataFrame:
    """The digest columns of format_chats, all read back from its output: turns from the text, the loss text from under the mask."""

    def digests(turns: Column) -> Column:
        said = F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
        return F.struct(F.size(turns).cast("long").alias("n"), F.sha2(said, 256).alias("sha"))

    loss = let(masked_text(F.col("formatted"), F.col("loss_spans")), lambda x: F.struct(F.length(x).cast("long").alias("n"), F.sha2(x, 256).alias("sha")))
    out = format_chats(chats).select("conv_id", let(read_back(F.col("formatted")), digests).alias("back"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"), "n_blocks")
    return out.select("conv_id", F.col("back.n").alias("n_turns"), F.col("back.sha").alias("turns_sha256"), F.col("loss.n").alias("loss_chars"), F.col("loss.sha").alias("loss_sha256"), "formatted_chars", "n_blocks")


#: The conversation that the query adds: texts made of other templates' control strings.
PLANTED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def query(chats: DataFrame) -> DataFrame:
    planted = chats.sparkSession.createDataFrame(PLANTED, "conv_id long, turn int, role string, text string")
    return chat_digests(chats.select("conv_id", "turn", "role", "text").unionByName(planted))


def oracle_sql() -> str:
    esc = lambda s: rf"regexp_replace({s}, '([<\[])(\\*){CONTROL_TAIL}', '\1\\\2\3', 'g')"
    marks = len(TURN) + len(TEXT) + len(END)
    planted = ", ".join(f"({c}, {t}, '{r}', '{x}')" for c, t, r, x in PLANTED)
    return f"""WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT * FROM (VALUES {planted}) AS v(conv_id, turn, role, text)),
    marked AS (SELECT *, row_number() OVER w AS place, lag(role) OVER w IS DISTINCT FROM role AS first FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = '{LOSS_ROLE}'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = '{LOSS_ROLE}'), '')) AS loss_sha256,
      sum(length({esc('text')}) + CASE WHEN first THEN length({esc('role')}) + {marks} ELSE {len(MORE)} END)::BIGINT AS formatted_chars,
      count(*) FILTER (first) AS n_blocks FROM marked GROUP BY conv_id"""
