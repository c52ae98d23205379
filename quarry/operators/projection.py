"""Which source events are kept, by all their structured fields, and how items are released."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import generic_marker

#: Dispositions are tried in the order of ``source_disposition``.
COORDINATION = ("agent_to_agent", "agent_to_subagent", "subagent_to_agent")
FEEDBACK = ("correction", "feedback", "preference", "review")
HUMAN_ARTIFACTS = ("attachment", "image")
REASONING = ("agent_plan", "agent_reasoning", "reasoning_summary", "thinking")
HUMANS, AGENTS, SPOKEN = ("human", "speaker", "user"), ("ai", "assistant", "agent"), ("message", "record", "speech")
RELEASED = ("message", "record")
ACTION_LABELS = {
    "system": "[system action]", "tool_call": "[tool call]", "tool_result": "[tool result]", "artifact": "[artifact]", "git": "[version control]",
    "version_control": "[version control]", "agent_event": "[agent event]", "user_event": "[user event]", "action_label": "[action]",
}
SOURCE_SYSTEMS = ("codex", "claude-code", "claude-ai-export", "meeting-transcript", "local-agent-history")


def source_disposition(
    event_type: Column, actor: Column, record_type: Column, direction: Column, text: Column, kind: Column, maker_kept: Column, role: Column, interaction: Column, attached: Column
) -> Column:
    """The first rule that fits an event. ``maker_kept`` says whether the event that made an artifact is kept, ``attached`` whether a message has attachments."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    event, who, way = low(event_type), low(actor), low(direction)
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    marker, human, spoken = ~blank & generic_marker(text), who.isin(*HUMANS), event.isin(*SPOKEN)
    agent = (event == "agent") | F.coalesce(record_type == "sub_agent_activity", F.lit(False))
    made = low(kind).isin(*HUMAN_ARTIFACTS) & F.coalesce(maker_kept, F.lit(False))
    together = way.isin(*COORDINATION)
    return (
        F.when(event == "tool_call", "drop_tool_call")
        .when(event == "tool_result", "drop_tool_result")
        .when(event == "git", "drop_execution_observation")
        .when(agent & blank, "drop_agent_plumbing")
        .when(agent & marker, "drop_generic_execution_marker")
        .when(agent, F.when(together, "keep_agent_coordination").otherwise("keep_meaningful_progress"))
        .when(event == "system", "drop_system_machinery")
        .when(event == "artifact", F.when(made, "keep_human_source").otherwise("drop_machine_artifact"))
        .when(blank & ~(spoken & F.coalesce(attached, F.lit(False))), "drop_ambiguous")
        .when(marker & ~human, "drop_generic_execution_marker")
        .when((event == "reasoning") & F.coalesce(record_type.isin(*REASONING), F.lit(False)), "keep_recorded_reasoning")
        .when(event.isin("progress", "status"), "keep_meaningful_progress")
        .when(spoken & human, F.when(low(interaction).isin(*FEEDBACK), "keep_human_feedback").otherwise("keep_human_dialogue"))
        .when(spoken & (together | F.coalesce(record_type == "agent_message", F.lit(False))), "keep_agent_coordination")
        .when(spoken & who.isin(*AGENTS) & low(role).isin("", "assistant"), "keep_agent_dialogue")
        .otherwise("drop_ambiguous")
    )


def release_label(event_type: Column) -> Column:
    out = F.lit("[action]")
    for kind, label in ACTION_LABELS.items():
        out = F.when(event_type == kind, label).otherwise(out)
    return out
