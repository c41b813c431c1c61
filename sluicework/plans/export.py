"""Schedules for other systems, made from a task's file."""

from __future__ import annotations

import json
import shlex
from pathlib import Path

from .spec import Orchestration, load


def command(folder: Path, profile: str | None) -> list[str]:
    """The command line of a run, as ``cli`` parses it."""
    usecase, package, task = folder.resolve().parts[-3:]
    return ["sluicework", "run", "-d", str(folder.resolve().parents[2]), "-u", usecase, "-p", package, "-t", task, *(["--profile", profile] if profile else [])]


def airflow(folder: str, profile: str | None = None) -> str:
    """A DAG file with one task."""
    path = Path(folder)
    config = load(path, {"dt": "{{ ds }}"})
    plan = config.ORCHESTRATION or Orchestration()
    line = shlex.join(command(path, profile)) + " -dt '{{ ds }}'"
    name = "_".join(path.resolve().parts[-3:])
    return "\n".join([
        "from datetime import datetime, timedelta", "", "from airflow import DAG", "from airflow.operators.bash import BashOperator", "",
        f"with DAG({name!r}, schedule={plan.schedule!r}, start_date=datetime(2024, 1, 1), catchup=False, tags={plan.tags!r},",
        f"         default_args={{'owner': {plan.owner!r}, 'retries': {plan.retries}, 'retry_delay': timedelta(minutes=5)}}):",
        f"    BashOperator(task_id={path.name!r}, bash_command={line!r})", "",
    ])


def databricks(folder: str, profile: str | None = None) -> str:
    """A job description with one task."""
    path = Path(folder)
    plan = load(path, {"dt": "{{job.start_time.iso_date}}"}).ORCHESTRATION or Orchestration()
    extra = (plan.model_extra or {}).get("databricks") or {}
    job = {
        "name": "_".join(path.resolve().parts[-3:]),
        "tags": {t: "" for t in plan.tags},
        "tasks": [{"task_key": path.name, "max_retries": plan.retries, "python_wheel_task": {"package_name": "sluicework", "entry_point": "sluicework", "parameters": command(path, profile)[1:]}, **extra}],
    }
    if plan.schedule:
        job["schedule"] = {"quartz_cron_expression": plan.schedule, "timezone_id": "UTC"}
    return json.dumps(job, indent=2)
