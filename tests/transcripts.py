"""Small transcripts as files, as agents write them."""

import json
from pathlib import Path


def event(uuid, session, kind, ts, content, parent=None, model=None, usage=None, role=None, **more):
    message = {"role": role or kind, "content": content, "model": model}
    if usage:
        message["usage"] = dict(zip(("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens"), usage, strict=True))
    return {"uuid": uuid, "parentUuid": parent, "sessionId": session, "type": kind, "timestamp": ts, "isSidechain": False, "cwd": "/w", "gitBranch": "main", "unlisted": 1, "message": message} | more


def text(body):
    return {"type": "text", "text": body}


def tool(call, name, **given):
    return {"type": "tool_use", "id": call, "name": name, "input": given}


def result(call, content, **more):
    return {"type": "tool_result", "tool_use_id": call, "content": content} | more


LONG = "this is a message that is longer than the floor of the view"


def corpus() -> dict[str, list[dict]]:
    todos = lambda *x: {"todos": [{"content": c, "status": s, "activeForm": c} for c, s in x]}
    one = [
        event("u1", "s1", "user", "2024-03-01T10:00:00.000Z", [text(LONG + " one")]),
        event("a1", "s1", "assistant", "2024-03-01T10:00:01.500Z", [text(LONG), text("second block"), tool("t1", "Read", path="x")], parent="u1", model="claude-opus-4-7-20250101", usage=(1000, 2000, 500, 4000)),
        event("u2", "s1", "user", "2024-03-01T10:00:02.000Z", [result("t1", "boom", is_error=True)], parent="a1"),
        event("u3", "s1", "user", "2024-03-01T10:00:03.000Z", "why did that fail?", parent="u2"),
        event("a2", "s1", "assistant", "2024-03-01T10:00:04.000Z", [tool("t2", "TodoWrite", **todos(("A", "pending"), ("B", "pending")))], parent="u3", model="unknown-model"),
        event("a3", "s1", "assistant", "2024-03-01T10:00:05.000Z", [tool("t3", "TodoWrite", **todos(("A", "completed"), ("B", "in_progress")))], parent="a2"),
        event("u4", "s1", "user", "2024-03-01T10:00:06.000Z", [text("Stop. " + LONG)], parent="a3"),
        event("c1", "s1", "user", "2024-03-01T10:00:07.000Z", [text(LONG + " compact")], isCompactSummary=True),
    ]
    two = [
        event("v1", "s2", "user", "2024-03-02T09:00:00Z", "<command-name>/review</command-name><command-args>now</command-args>"),
        event("v2", "s2", "user", "2024-03-02T09:00:30Z", [text(LONG + " again")], parent="v1"),
        event("b1", "s2", "assistant", "2024-03-02T09:01:00Z", [tool("k1", "Skill", skill="deploy", args="fast"), tool("k2", "Agent", subagent_type="scout", description="d", prompt="p", run_in_background=True)], parent="v2", model="claude-haiku-4-5"),
        event("b2", "s2", "assistant", "2024-03-02T09:02:00Z", [tool("k3", "TaskCreate", subject="first", description="x", metadata={"b": 1, "a": 2}), tool("k4", "TaskCreate", subject="second")]),
        event("v3", "s2", "user", "2024-03-02T09:02:01Z", [result("k3", "Task #7 created successfully"), result("k4", "made it")]),
        event("b3", "s2", "assistant", "2024-03-02T09:03:00Z", [tool("k5", "TaskUpdate", taskId="7", status="completed", addBlockedBy=["2"])]),
        event("v4", "s2", "user", "2024-03-02T09:04:00Z", [text("<command-name>/plan</command-name> " + LONG)]),
        event("x1", "s2", "attachment", "2024-03-02T09:05:00Z", [text(LONG)]),
    ]
    return {"s1": one, "s2": two}


PARENT = "0a1b2c3d-1111-2222-3333-444455556666"


def write(root: Path) -> Path:
    project = root / "project"
    project.mkdir(parents=True)
    for session, events in corpus().items():
        lines = [json.dumps(e) for e in events]
        if session == "s1":
            lines.insert(2, "{broken")
        (project / f"{session}.jsonl").write_text("\n".join(lines) + "\n")
    part = project / "s3"
    part.mkdir()
    (part / "part-1.jsonl").write_text(json.dumps(event("p1", "s3", "user", "2024-03-03T00:00:00Z", [text(LONG)])) + "\n")
    agents = project / PARENT / "subagents"
    agents.mkdir(parents=True)
    rows = [event(f"g{k}", "g-session", "assistant", f"2024-03-02T09:0{k}:00Z", [text(LONG)], model="claude-haiku-4-5") for k in (1, 2)]
    (agents / "agent-ab12.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")
    (agents / "agent-ab12.meta.json").write_text(json.dumps({"agentType": "scout", "description": "looks\naround"}, indent=1))
    return root
