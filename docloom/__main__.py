"""``python -m docloom ingest MANIFEST ROOT``, ``search ROOT QUESTION`` and ``ask ROOT [QUESTION]``.

``ask --chat`` keeps a conversation: /memory shows its window, /reset empties
it, /quit or /exit or the end of input ends it.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from docloom.config import SETTINGS, Settings
from docloom.functions import guardrails as gr
from docloom.operators import answer, embed, index, memory, retrieve
from docloom.plans import ingest

#: Characters shown of a hit and of a remembered message.
HIT_CHARS, MEMORY_CHARS = 400, 90


class Session:
    """Questions put to one index, with the messages said so far."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings = SETTINGS, threshold: float | None = None):
        self.spark, self.settings, self.threshold = spark, settings, threshold
        self.encoder = embed.HashingEmbedder(settings.embed_dim)
        self.store = index.VectorIndex(spark, f"{root}/index")
        self.store.check(self.encoder)
        self.said: list[tuple[str, str]] = []

    def one(self, question: str) -> DataFrame:
        return self.spark.createDataFrame([(1, question)], "query_id bigint, question string")

    def screened(self, question: str) -> Row:
        return gr.screen(self.one(question), "question").first()

    def hits(self, question: str) -> DataFrame:
        return retrieve.retrieve(self.one(question), self.store.vectors(), self.encoder, self.settings, threshold=self.threshold)

    def standalone(self, question: str) -> str:
        """The question with the subject that the window last named, if it hangs on one."""
        turns = [(1, n, role, text) for n, (role, text) in enumerate([*self.said, ("user", question)])]
        told = memory.rewritten_turns(self.spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"), keep=self.settings.memory_max_messages)
        return told.orderBy(F.desc("turn")).first().standalone

    def remember(self, question: str, reply: str) -> None:
        self.said = [*self.said, ("user", question), ("assistant", reply)][-self.settings.memory_max_messages :]


def _hit_lines(hits: list[Row], chars: int | None) -> list[str]:
    lines = []
    for h in hits:
        lines.append(f"{h['rank']:>3} {h.score:.4f} {h.chunk_id} {h.scheme}/{h.plan}/{h.doc_type}")
        lines += [f"    {h.document[:chars]}"] if chars != 0 else []
    return lines


def search(session: Session, question: str, full: bool) -> list[str]:
    """Verdict, filter and hits of a question; one that is not factual is not searched for."""
    told = session.screened(question)
    lines = [f"verdict {told.verdict}" + (f" by {told.matched or told.pii_pattern}" if told.verdict != "FACTUAL" else "")]
    if told.verdict != "FACTUAL":
        return lines
    wanted = retrieve.resolve(session.one(question)).first()
    limits = [f"{k}={v}" for k, v in (("scheme", wanted.want_scheme), ("plan", wanted.want_plan)) if v]
    hits = session.hits(question).orderBy("rank").collect()
    floor = session.settings.similarity_threshold if session.threshold is None else session.threshold
    return [*lines, f"filter {', '.join(limits) or 'none'}", f"hits {len(hits)} at {floor}", *_hit_lines(hits, None if full else 0)]


def reply(session: Session, question: str, chunks: bool = True, trace: bool = False, chat: bool = False) -> list[str]:
    """An answer with its source, the hits it was made from and, on demand, its trace, which holds no text."""
    told = session.screened(question)
    asked = session.standalone(question) if chat and told.verdict == "FACTUAL" else question
    hits = session.hits(asked)
    envelopes = answer.respond(session.one(asked), hits, settings=session.settings)
    envelope = envelopes.first()
    if chat and told.verdict != "PII":
        session.remember(question, envelope.answer)
    lines = [f"searched as: {asked}"] if asked != question else []
    lines += [f"verdict {told.verdict}", f"template {envelope.template_id}", envelope.answer]
    lines += [x for x in (envelope.citation_url, envelope.last_updated) if x]
    if chunks and told.verdict == "FACTUAL":
        lines += _hit_lines(hits.orderBy("rank").collect(), HIT_CHARS)
    if trace:
        rows = answer.pii_trace_rows(gr.screen(session.one(question), "question")) if told.verdict == "PII" else answer.trace_rows(envelopes)
        lines += [r.value for r in rows.collect()]
    return lines


def chat(session: Session, chunks: bool, trace: bool, read: Callable[[str], str] = input, write: Callable[[str], None] = print) -> None:
    """Questions of ``read`` until it ends."""
    while True:
        try:
            question = read("> ").strip()
        except (EOFError, KeyboardInterrupt):
            return
        if question in ("/quit", "/exit"):
            return
        if question == "/memory":
            write(f"{len(session.said)}/{session.settings.memory_max_messages} messages")
            for role, text in session.said:
                write(f"  {role}: {text[:MEMORY_CHARS]}")
        elif question == "/reset":
            session.said = []
            write("nothing is remembered")
        elif question:
            for line in reply(session, question, chunks, trace, chat=True):
                write(line)


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="python -m docloom")
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("ingest", help="build or update an index")
    build.add_argument("manifest")
    build.add_argument("root")
    for flag in ("only-fetch", "only-embed", "force", "no-prune"):
        build.add_argument(f"--{flag}", action="store_true")
    find = commands.add_parser("search", help="show what is found for a question")
    find.add_argument("--full", action="store_true", help="with the hits' texts")
    ask = commands.add_parser("ask", help="answer a question, or several in a conversation")
    for flag in ("chat", "no-chunks", "trace"):
        ask.add_argument(f"--{flag}", action="store_true")
    for command, many in ((find, None), (ask, "?")):
        command.add_argument("root")
        command.add_argument("question", nargs=many, default="")
        command.add_argument("--top-k", type=int)
        command.add_argument("--threshold", type=float)
    given = parser.parse_args(arguments)
    asks = given.command != "ingest"
    if asks and not given.question.strip() and not getattr(given, "chat", False):
        parser.error("a question is needed")
    spark, settings = SparkSession.builder.appName("docloom").getOrCreate(), Settings.from_env()
    if not asks:
        print(ingest.build(spark, given.manifest, given.root, settings=settings, only_fetch=given.only_fetch, only_embed=given.only_embed, force=given.force, prune=not given.no_prune))
        return 0
    session = Session(spark, given.root, settings if given.top_k is None else replace(settings, top_k=given.top_k), given.threshold)
    if given.command == "search":
        print(*search(session, given.question.strip(), given.full), sep="\n")
    elif given.chat:
        chat(session, not given.no_chunks, given.trace)
    else:
        print(*reply(session, given.question.strip(), not given.no_chunks, given.trace), sep="\n")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
