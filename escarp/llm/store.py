"""Where intermediate results live: the folder that the cluster shares."""

from escarp.storage import cleaned, dropped, new_path, remove, shared_folder, written

__all__ = ["cleaned", "dropped", "new_path", "remove", "shared_folder", "written"]
