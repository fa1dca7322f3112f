"""Write session-log folders for tests."""

import json
from pathlib import Path


def session(sid, n=2, start=0, created=1_700_000_000_000, text="do {i} in /data/x/{i}.csv"):
    body = {"creationDate": created, "lastMessageDate": created + 1000 * n, "requests": [
        {"message": {"text": text.format(i=i)}, "timestamp": created + i,
         "response": [{"kind": "markdownContent", "value": f"answer {i}"}]} for i in range(start, n)]}
    if sid is not None:
        body["sessionId"] = sid
    return body


def write(root: Path, workspace: str, name: str, body) -> None:
    folder = root / workspace / "chatSessions"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{name}.json").write_text(body if isinstance(body, str) else json.dumps(body))


def workspace(root: Path, name: str, body) -> None:
    (root / name).mkdir(parents=True, exist_ok=True)
    (root / name / "workspace.json").write_text(body if isinstance(body, str) else json.dumps(body))
