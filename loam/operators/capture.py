"""Capture: cleaning of incoming texts, what is worth keeping, error texts, display texts, and the path from messages to memories.

Nulls count as empty texts. The patterns are fixed values; names of hosts in them are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.operators import extract, gates
from loam.scratch import written

# Fixed values.
RESET_PREFIX = "A new session was started via /new or /reset. Execute your Session Startup sequence now"
INBOUND = ["Conversation info (untrusted metadata):", "Sender (untrusted metadata):", "Thread starter (untrusted, for context):", "Replied message (untrusted, for context):", "Forwarded message context (untrusted metadata):", "Chat history since last reply (untrusted, for context):"]
ADDRESSING = r"^(?:<@!?[0-9]+>|@[A-Za-z0-9_.-]+)\s*"
EVENT_LINE = r"(?im)^System:\s*\[[^\n]*?\]\s*Exec\s+(?:completed|failed|started)\b.*$"
METADATA_HEAD = r"(?im)^(Conversation info|Sender) \(untrusted metadata\):[\s\S]*?\n\s*\n"
ENVELOPE = [r"(?m)^System:\s*\[[\d\-: +GMT]+\]\s+\S+\[.*?\].*$", r"(?:Conversation info|Sender|Replied message)\s*\(untrusted[^)]*\):\s*```json\s*\{[\s\S]*?\}\s*```", r"```json\s*\{[^}]*\"message_id\"\s*:[^}]*\"sender_id\"\s*:[^}]*\}\s*```"]
TRIGGERS = [r"(?i)zapamatuj si|pamatuj|remember", r"(?i)preferuji|radši|nechci|prefer", r"(?i)rozhodli jsme|budeme používat", r"(?i)\b(we )?decided\b|we'?ll use|we will use|switch(ed)? to|migrate(d)? to|going forward|from now on", r"\+\d{10,}", r"[\w.-]+@[\w.-]+\.\w+", r"(?i)můj\s+\w+\s+je|je\s+můj", r"(?i)my\s+\w+\s+is|is\s+my", r"(?i)i (like|prefer|hate|love|want|need|care)", r"(?i)always|never|important", "記住|记住|記一下|记一下|別忘了|别忘了|備註|备注", "偏好|喜好|喜歡|喜欢|討厭|讨厌|不喜歡|不喜欢|愛用|爱用|習慣|习惯", "決定|决定|選擇了|选择了|改用|換成|换成|以後用|以后用", r"我的\S+是|叫我|稱呼|称呼", "老是|講不聽|總是|总是|從不|从不|一直|每次都", "重要|關鍵|关键|注意|千萬別|千万别", "幫我|筆記|存檔|存起來|存一下|重點|原則|底線"]
EXCLUDED = [r"(?i)\b(memory_store|memory_recall|memory_forget|memory_update)\b", r"(?i)\b(delete|remove|forget|purge|cleanup|clean up|clear)\b.*\b(memory|memories|entry|entries)\b", r"(?i)\b(memory|memories)\b.*\b(delete|remove|forget|purge|cleanup|clean up|clear)\b", r"(?i)\bhow do i\b.*\b(delete|remove|forget|purge|cleanup|clear)\b", "(?i)(删除|刪除|清理|清除).{0,12}(记忆|記憶|memory)"]
REMEMBER = r"^(?:请|請)?(?:记住|記住|记一下|記一下|别忘了|別忘了)[。.!?？!]*\z"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _blank_lines(c: Column) -> Column:
    return T.trim(F.regexp_replace(c, "\n{3,}", "\n\n"))


def without_reset(s: Column) -> Column:
    """What follows the text of a session's start in a trimmed text: after its first empty line, else after its second line."""
    at = F.instr(s, "\n\n")
    rest = F.when(at > 0, F.substring(s, at + 2, F.length(s))).otherwise(F.array_join(F.slice(F.split(s, "\n"), 3, 1_000_000), "\n"))
    return F.when(s.startswith(RESET_PREFIX), T.trim(rest)).otherwise(s)


def without_inbound(c: Column, passes: int = 3) -> Column:
    """Without event lines and blocks of inbound metadata, of which one may follow another."""
    heads = "|".join("".join("\\" + x if x in "().:" else x for x in h) for h in INBOUND)
    block = rf"(?:^|\n)\s*(?:{heads})\s*\n```json[\s\S]*?\n```\s*"
    needs = c.contains("System:") | c.contains("(untrusted")
    out = c
    for _ in range(passes):
        out = _blank_lines(F.regexp_replace(F.regexp_replace(out, EVENT_LINE, "\n"), block, "\n"))
    return F.when(needs, out).otherwise(_blank_lines(c))


def normalised(messages: DataFrame) -> DataFrame:
    """``messages`` (role, text, ...) with ``text`` without injected blocks, metadata and forms of address; null if nothing is
    left or it is unsafe. Each step is a column of its own, so that none is computed again within the next."""
    x = messages.withColumn("__t", T.trim(_text(F.col("text"))))
    own = F.regexp_replace(F.regexp_replace("__t", r"(?i)<relevant-memories>\s*[\s\S]*?</relevant-memories>\s*", ""), r"(?i)\[UNTRUSTED DATA[^\n]*\][\s\S]*?\[END UNTRUSTED DATA\]\s*", "")
    x = x.withColumn("__u", T.trim(own)).withColumn("__u", without_reset(F.col("__u"))).withColumn("__u", without_inbound(F.col("__u")))
    x = x.withColumn("__u", T.trim(F.regexp_replace("__u", ADDRESSING, ""))).withColumn("__u", without_inbound(F.col("__u")))
    x = x.withColumn("__u", F.when(F.col("role") == "user", F.col("__u")).otherwise(F.col("__t")))
    x = x.withColumn("__v", gates.capture_verdict(F.col("__u"))).withColumn("__u", extract.sanitized(F.col("__u")))
    return x.withColumn("text", F.when(F.col("role").isNotNull() & (F.col("__v") == "allowed") & (F.col("__u") != ""), F.col("__u"))).drop("__t", "__u", "__v")


def without_envelope(c: Column) -> Column:
    out = _text(c)
    for p in ENVELOPE:
        out = F.regexp_replace(out, p, "")
    return _blank_lines(out)


def should_capture(c: Column) -> Column:
    """Whether a text is worth a memory by its form: length, safety, no markup or list, few emoji, a trigger."""
    s = F.regexp_replace(T.trim(_text(c)), METADATA_HEAD, "")
    n = T.utf16_len(s)
    length = (n >= F.when(s.rlike(T.CJK), 4).otherwise(10)) & (n <= 500)
    markup = s.contains("<relevant-memories>") | (s.startswith("<") & s.contains("</")) | (s.contains("**") & s.contains("\n-"))
    emoji = F.regexp_count(s, F.lit(r"[\x{1F300}-\x{1F9FF}]")) > 3
    return length & ~markup & ~emoji & T.any_of(s, TRIGGERS) & ~T.any_of(s, EXCLUDED) & (gates.capture_verdict(s) == "allowed")


def skipped_message(role: Column, text: Column) -> Column:
    s = T.trim(_text(text))
    injected = s.contains("<relevant-memories>") | s.contains("UNTRUSTED DATA") | s.contains("END UNTRUSTED DATA")
    return (s == "") | s.startswith("/") | ((role == "user") & injected)


def is_remember_command(c: Column) -> Column:
    return T.trim(_text(c)).rlike(REMEMBER)


def conversation_key(channel: Column, conversation: Column) -> Column:
    a, b = T.trim(_text(channel)), T.trim(_text(conversation))
    return F.when((a != "") & (b != ""), F.concat(a, F.lit(":"), b))


def conversation_of_session(session_key: Column) -> Column:
    """What follows ``agent:<id>:`` in a session's key."""
    return F.nullif(T.trim(F.regexp_extract(T.trim(_text(session_key)), r"^agent:[^:]+:(.+)$", 1)), F.lit(""))


def error_hash(c: Column) -> Column:
    """Sixteen hexadecimal digits that equal errors share, whatever their paths and numbers."""
    return F.substring(F.sha2(gates.error_signature(c), 256), 1, 16)


def error_summary(c: Column, most: int = 220) -> Column:
    s = T.one_line(gates.redacted(_text(c)))
    return F.when(s == "", "(empty tool error)").when(T.utf16_len(s) <= most, s).otherwise(F.concat(F.substring(s, 1, most - 3), F.lit("...")))


def for_context(c: Column, most: int = 300) -> Column:
    """One line without tags; angle brackets that are left become full-width ones."""
    s = F.regexp_replace(F.regexp_replace(_text(c), r"[\r\n]+", " "), r"</?[a-zA-Z][^>]*>", "")
    return F.substring(T.one_line(F.translate(s, "<>", "＜＞")), 1, most)


def first_sentence(c: Column, most: int = 80) -> Column:
    end = F.regexp_instr(c, F.lit(r"[.!?]\s|[。！？]"))
    cut = F.substring(c, 1, most)
    space = F.length(cut) - F.instr(F.reverse(cut), " ")
    word = F.when((F.instr(cut, " ") > 0) & (space > most * 0.6), F.substring(cut, F.lit(1), space)).otherwise(cut)
    return F.when((end > 1) & (end <= most), F.substring(c, F.lit(1), end)).when(F.length(c) <= most, c).otherwise(F.concat(word, F.lit("...")))


def at_depth(text: Column, category: Column, scope: Column, depth: Column, score: Column, sources: Column) -> Column:
    """A line of context: the first sentence (l0), up to 300 characters (l1) or the whole text."""
    tail = F.concat(F.lit(" ("), F.format_number(score * 100, 0), F.lit("%"), F.when(_text(sources) != "", F.concat(F.lit(", "), sources)).otherwise(""), F.lit(")"))
    middle = F.when(F.length(text) > 300, F.concat(F.substring(text, 1, 297), F.lit("..."))).otherwise(text)
    body = F.when(depth == "l0", F.concat(category, F.lit("] "), first_sentence(text))).otherwise(F.concat(category, F.lit(":"), scope, F.lit("] "), F.when(depth == "l1", middle).otherwise(text)))
    return F.concat(F.lit("- ["), body, tail)


def inline(c: Column, most: int | None = None) -> Column:
    s = T.one_line(_text(c))
    return s if most is None else F.when(F.length(s) <= most, s).otherwise(F.concat(F.substring(s, 1, most - 1), F.lit("…")))


def captured(messages: DataFrame, most: int = 2) -> DataFrame:
    """(conversation, n, text, category, importance): the first ``most`` texts of each conversation that are worth keeping.

    messages: (conversation, n, role, text) in order of n. Importance is 0.7, as for any captured text."""
    x = written(normalised(messages.where("role = 'user'")), "captured").where("text is not null")  # the steps run once
    x = x.where(should_capture(F.col("text")) & ~gates.is_noise(F.col("text")))
    x = x.withColumn("r", F.row_number().over(W.partitionBy("conversation").orderBy("n"))).where(F.col("r") <= most)
    return x.select("conversation", "n", "text", gates.category(F.col("text")).alias("category"), F.lit(0.7).alias("importance"))
