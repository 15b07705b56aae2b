import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

DATA = "/root/testdata/sf0.001"
BLOCK = "struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean,thinking:string>"
RECORDS = (
    "rec_id bigint, session_id string, uuid string, rec_type string, agent string, record_index int, ts_raw string, ts timestamp, ingested_at timestamp, cwd string,"
    " is_meta boolean, is_replay boolean, is_api_error boolean, subtype string, content string, lang string,"
    f" message struct<role:string,model:string,id:string,content:array<{BLOCK}>,usage:struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint>>"
)


@pytest.fixture(scope="session")
def spark():
    from threadloom.session import local_session

    s = local_session(4, **{"spark.sql.shuffle.partitions": "4"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


def block(type="text", text=None, id=None, name=None, input=None, tool_use_id=None, content=None, is_error=None):
    return (type, text, id, name, input, tool_use_id, content, is_error, None)


def record(rec_id, session="s1", uuid="", type="user", index=0, ts=None, role="", blocks=(), model=None, usage=None, meta=None, replay=None, error=None, lang=None, message_id=None, text=None):
    """A row of records; uuid and role default to a fresh id and the type."""
    from datetime import datetime, timezone

    ts = datetime(2026, 1, 1, tzinfo=timezone.utc) if ts is None else ts
    blocks = [block(text=text)] if text is not None else list(blocks)
    message = (type if role == "" else role, model, message_id, blocks, usage)
    return (rec_id, session, f"u{rec_id}" if uuid == "" else uuid, type, "claude", index, None, ts, ts, None, meta, replay, error, None, None, lang, message)


@pytest.fixture(scope="session")
def make_records(spark):
    return lambda rows: spark.createDataFrame(rows, RECORDS)
