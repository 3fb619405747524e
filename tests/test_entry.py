"""The entry file without a session, from another folder, and without the optional subpackage."""

import os
import shutil
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import importlib.util as u; s = u.spec_from_file_location('e', r'{}/__spark_entry__.py'); m = u.module_from_spec(s); s.loader.exec_module(m); print(len(m.queries()), len(m.oracle_sql()))"


def counts(repo):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", COUNT.format(repo)], cwd=tempfile.gettempdir(), env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    return tuple(map(int, out.stdout.split()[-2:]))


def test_queries_need_no_session_and_no_subpackage():
    own = counts(REPO)
    base = tempfile.mkdtemp(prefix="kohort-entry-")
    shutil.copy(f"{REPO}/__spark_entry__.py", base)
    shutil.copytree(f"{REPO}/kohort", f"{base}/kohort", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    rest = counts(base)
    assert rest[0] >= 135 and rest[1] >= 125
    if os.path.isdir(f"{REPO}/kohort/llm"):
        assert own[0] == rest[0] + 14     # thirteen operators and the pipeline
