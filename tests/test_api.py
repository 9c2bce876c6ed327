import os
import subprocess
import sys

import stylograph


def test_public_names():
    assert len(stylograph.__all__) == 21 and all(hasattr(stylograph, n) for n in stylograph.__all__)


def test_records(spark, tmp_path):
    (tmp_path / "tweets.js").write_text('x = [{"id": "1", "text": "a calm harbour and its many old boats"}, {"id": "2", "text": "RT @a no"}]')
    posts = stylograph.load_archive(spark, str(tmp_path))
    assert posts.columns == stylograph.ArchivePost.names
    assert [tuple(r) for r in stylograph.own_post_texts(posts).collect()] == [(0, "a calm harbour and its many old boats")]
    assert stylograph.curate(posts).columns == stylograph.Exemplar.names
    assert stylograph.curate(posts).schema["score"].dataType == stylograph.Exemplar["score"].dataType


def test_workers_find_the_package_from_any_folder(tmp_path):
    """A session made by get_session ships the package, wherever the process was started."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(stylograph.__file__)))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from stylograph.session import get_session\nfrom stylograph.operators import model as M\n"
        "spark = get_session('ship', 'local[1]', spark__ui__enabled='false')\n"
        "print(spark.createDataFrame([('[\"a\"]',)], 'x string').select(M.parse_facts('x').alias('p')).first().p['values'])\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "['a']" in done.stdout, done.stderr[-2000:]
