"""Shards and blocks of queries as files in the shared folder, so that vectors needn't be copied through a shuffle for each search task."""

from __future__ import annotations

from quire.llm.common import store


def written(path: str, name: str, data: bytes) -> None:
    """Writes a file that gets its name only when whole; a task that runs again writes the same."""
    from pyspark import TaskContext

    files, at = store(path)
    files.create_dir(at, recursive=True)
    draft = f"{at}/.draft-{TaskContext.get().taskAttemptId()}-{name}"
    with files.open_output_stream(draft) as f:
        f.write(data)
    files.move(draft, f"{at}/{name}")


def there(path: str, name: str) -> bool:
    files, at = store(path)
    return files.get_file_info(f"{at}/{name}").is_file


def read(path: str, name: str) -> bytes:
    files, at = store(path)
    with files.open_input_stream(f"{at}/{name}") as f:
        return f.read()
