"""Worker-side helpers must load where the package is not on the path."""

import subprocess
import sys

from pyspark import cloudpickle

from nearshelf.functions import blocks


def test_helpers_travel_by_value(tmp_path):
    (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps(blocks.best_of_stream))
    load = "import pickle, sys; f = pickle.load(open('f.pkl', 'rb')); assert 'nearshelf' not in sys.modules; print(f.__name__)"
    env = {"PATH": "/usr/bin:/bin"}
    out = subprocess.run([sys.executable, "-c", load], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=60)
    assert out.stdout.strip() == "best_of_stream", out.stderr
