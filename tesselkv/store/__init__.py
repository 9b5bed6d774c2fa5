"""A transactional store of versioned records on files."""

from tesselkv.store.config import Config
from tesselkv.store.store import Store
from tesselkv.store.txn import Entry, Item, Txn

__all__ = ["Config", "Entry", "Item", "Store", "Txn"]
