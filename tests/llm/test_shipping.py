import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
RUN = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from tarnflow.llm.pieces import encode
from tarnflow.llm.prefixes import trie
from tarnflow.llm.spelling import variants
import corpus_pipeline
spark = SparkSession.builder.master("local-cluster[1,2,1024]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {folder!r}).getOrCreate()
docs = spark.createDataFrame([(i, "Writing something of the letters number " + str(i), "en", "s", 40) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
assert encode(docs).count() == 40
assert variants(docs).where("word = 'writing'").first().n == 40
assert trie(spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")).count() >= 1
assert corpus_pipeline.piece_ids(spark, docs, "").count() == 40
print("whole")
"""


def test_jobs_run_on_executors_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    (tmp_path / "script.py").write_text(RUN.format(repo=REPO, folder=f"file://{tmp_path}/shared"))
    done = subprocess.run([sys.executable, "script.py"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400, check=False)
    assert done.stdout.endswith("whole\n"), done.stderr[-3000:]
