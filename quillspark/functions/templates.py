"""Prompt materialisation: literal placeholder substitution and chat rendering.

Substitution is literal (``replace``, not ``regexp_replace``), so ``\\`` and ``$`` in an essay are
safe, and sequential: text inserted by an earlier placeholder is scanned by the later ones.
A null value gives a null message.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from .text import _col, py_strip


def _as_col(v) -> Column:
    return v if isinstance(v, Column) else F.col(v)


def fill(template, *pairs) -> Column:
    """Replace each ``(placeholder, value)`` in order; ``template`` is a column name or Column."""
    out = _col(template)
    for placeholder, value in pairs:
        out = F.replace(out, F.lit(placeholder), _as_col(value))
    return out


def fill_literal(template: str, *pairs) -> Column:
    """As ``fill`` on a literal template string."""
    out = F.lit(template)
    for placeholder, value in pairs:
        out = F.replace(out, F.lit(placeholder), _as_col(value))
    return out


def instruction(template="msg_user_instruction_template", prompt="prompt", essay="essay") -> Column:
    """Single-prompt instruction: ``@prompt`` and ``@essay``, both stripped first."""
    return fill(template, ("@prompt", py_strip(prompt)), ("@essay", py_strip(essay)))


def system_message(template="msg_system_template", trait="trait", description="description") -> Column:
    return fill(template, ("@trait", trait), ("@description", description))


def retrieval_message(template="msg_user_retrieval_template", prompt="prompt", essay="essay", trait="trait") -> Column:
    return fill(template, ("@prompt", prompt), ("@essay", essay), ("@trait", trait))


def score_message(template="msg_user_score_template", trait="trait", rubric="rubric") -> Column:
    return fill(template, ("@trait", trait), ("@rubric", rubric))


def render_single(msg_system="msg_system", msg_user="msg_user_instruction", template=C.SINGLE_TURN_TEMPLATE) -> Column:
    """``[INST] <<SYS>> ... [/INST]`` single-turn prompt."""
    return fill_literal(template, ("@msg_system", msg_system), ("@msg_user_instruction", msg_user))


def render_retrieval(msg_system="msg_system", msg_user="msg_user_retrieval", template=C.RETRIEVAL_TEMPLATE) -> Column:
    return fill_literal(template, ("@msg_system", msg_system), ("@msg_user_retrieval", msg_user))


def render_two_turn(
    msg_system="msg_system",
    msg_user_retrieval="msg_user_retrieval",
    msg_assistant_retrieval="msg_assistant_retrieval",
    msg_user_score="msg_user_score",
    template=C.TWO_TURN_TEMPLATE,
) -> Column:
    """Two-turn scoring prompt: the first reply is embedded before the scoring question."""
    return fill_literal(
        template,
        ("@msg_system", msg_system),
        ("@msg_user_retrieval", msg_user_retrieval),
        ("@msg_assistant_retrieval", msg_assistant_retrieval),
        ("@msg_user_score", msg_user_score),
    )


def message(role: str, content) -> Column:
    return F.struct(F.lit(role).alias("role"), _as_col(content).alias("content"))


def messages_single(msg_system="msg_system", msg_user="msg_user_instruction") -> Column:
    """One user message whose content is ``system + '\\n' + user``."""
    return F.array(message("user", F.concat(_as_col(msg_system), F.lit("\n"), _as_col(msg_user))))


def messages_two_turn(msg_system="msg_system", msg_user_retrieval="msg_user_retrieval",
                      msg_assistant_retrieval="msg_assistant_retrieval", msg_user_score="msg_user_score") -> Column:
    """user / assistant / user message list of the scoring turn."""
    return F.array(
        message("user", F.concat(_as_col(msg_system), F.lit("\n"), _as_col(msg_user_retrieval))),
        message("assistant", msg_assistant_retrieval),
        message("user", msg_user_score),
    )


def render_inst_chat(messages) -> Column:
    """Default renderer of a message list: ``<s>[INST] u [/INST]a</s>[INST] u2 [/INST]``.

    The real string depends on the model's own chat template; pass another renderer where needed.
    """
    return F.concat(F.lit(CHAT_PREFIX), F.array_join(F.transform(_as_col(messages), lambda m: inst_piece(m["role"], m["content"])), ""))


CHAT_PREFIX = "<s>"


def inst_piece(role, content) -> Column:
    """One message of the default chat format (user turns in [INST] tags, assistant turns closed)."""
    role, content = _as_col(role), _as_col(content)
    return (
        F.when(role == "user", F.concat(F.lit("[INST] "), content, F.lit(" [/INST]")))
        .when(role == "assistant", F.concat(content, F.lit("</s>")))
        .otherwise(F.concat(content, F.lit("\n")))
    )
