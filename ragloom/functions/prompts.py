"""Prompt templates and their filling as column expressions.

A template is split once, on the driver, into literal pieces and slot names;
the prompt column is ``concat`` of literals and slot columns. A slot value that
itself contains ``{question}`` is therefore never filled a second time.
"""

from __future__ import annotations

import re
import textwrap

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Prompt texts, refusal sentence, system message and separators,
# exactly as the reference sends them (the message prompt is dedented).
# ---------------------------------------------------------------------------
REFUSAL = "해당 경우에 대한 판례가 없기 때문에 답변을 드리기 어렵습니다"

LAWYER_HEADER = (
    "당신은 민법에 대해서 잘 알고 있는 변호사입니다.\n"
    "고객의 질문에 상세하게 답을 해줄 수 있다면, 일반인이 알아들을 수 있게 풀어서 설명하세요.\n"
    "해당 되는 법조항이 있다면 법조항을 포함하여 답변을 해주세요.\n"
    '만약 질문에 대한 답변이 없다면 "해당 경우에 대한 판례가 없기 때문에 답변을 드리기 어렵습니다" 라고 답하세요.\n'
    "판례를 찾을 수 있다면 판례를 포함하여 답변을 해주세요.\n"
)

BASELINE_TEMPLATE = LAWYER_HEADER + "\n#Question:\n{question}\n\n#Answer:"

CONTEXT_TEMPLATE = LAWYER_HEADER + "\n#Context:\n{reference}\n\n#Question:\n{question}\n\n#Answer:"

#: The retrieval chain's prompt: the same header with Context / Question / Answer lines.
CHAIN_TEMPLATE = LAWYER_HEADER + "\nContext: {context}\n\nQuestion: {question}\n\nAnswer:\n"

REFERENCE_TEMPLATE = (
    "당신은 민법 전문가입니다. 다음 reference를 참고하여 Question에 답변해주세요.\n"
    "\n#Question:\n{question}\n\n#reference:\n{reference}\n\n#Answer:"
)

SYSTEM_MESSAGE = ("당신은 민법에 정통한 변호사입니다. 주어진 참고 문서를 바탕으로 "
                  "사용자의 질문에 정확하고 상세하게 답변해주세요.")

DOCUMENTS_TEMPLATE = textwrap.dedent("""
    다음은 사용자의 질문과 관련된 참고 문서들입니다. 이 문서들을 참고하여 질문에 답변해주세요.

    참고 문서:
    {context}

    사용자 질문: {question}

    답변:
    """)

CONTEXT_SEPARATOR = "\n\n---\n\n"
REFERENCE_SEPARATOR = "\n\n"
SCORED_LINE = "[%.4f] %s → %s"
DOCUMENT_BLOCK = "Document %d:\nInput: %s\nOutput: %s"
ERROR_PREFIX = "Error processing your query: "

_SLOT = re.compile(r"\{(\w+)\}")


def template_parts(template: str) -> list[tuple[str, str]]:
    """Split a template into ``("lit", text)`` and ``("slot", name)`` parts."""
    parts, pos = [], 0
    for m in _SLOT.finditer(template):
        if m.start() > pos:
            parts.append(("lit", template[pos:m.start()]))
        parts.append(("slot", m.group(1)))
        pos = m.end()
    if pos < len(template):
        parts.append(("lit", template[pos:]))
    return parts


def fill(template: str, **slots: Column | str) -> Column:
    """Prompt column: each ``{name}`` replaced once by its column (null -> empty)."""
    cols = []
    for kind, v in template_parts(template):
        if kind == "lit":
            cols.append(F.lit(v))
        else:
            if v not in slots:
                raise KeyError(f"template slot {v!r} has no column")
            c = slots[v]
            cols.append(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    return F.concat(*cols)


def baseline_prompt(question: Column | str) -> Column:
    """No-context prompt."""
    return fill(BASELINE_TEMPLATE, question=question)


def context_prompt(reference: Column | str, question: Column | str) -> Column:
    """Lawyer prompt with the joined contexts."""
    return fill(CONTEXT_TEMPLATE, reference=reference, question=question)


def chain_prompt(context: Column | str, question: Column | str) -> Column:
    """C06, chain form: lawyer prompt with ``Context:`` and ``Question:`` lines."""
    return fill(CHAIN_TEMPLATE, context=context, question=question)


def reference_prompt(question: Column | str, reference: Column | str) -> Column:
    """Expert prompt with the scored reference block."""
    return fill(REFERENCE_TEMPLATE, question=question, reference=reference)


def chat_messages(context: Column | str, question: Column | str) -> Column:
    """``array<struct<role, content>>`` with the system and the user message."""
    user = fill(DOCUMENTS_TEMPLATE, context=context, question=question)
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_MESSAGE).alias("content")),
                   F.struct(F.lit("user").alias("role"), user.alias("content")))


def refusal_flag(answer: Column | str) -> Column:
    """The answer holds the refusal sentence."""
    a = F.col(answer) if isinstance(answer, str) else answer
    return F.coalesce(F.instr(a, REFUSAL) > 0, F.lit(False))
