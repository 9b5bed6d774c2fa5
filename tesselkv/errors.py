"""What can go wrong, as exceptions."""


class StoreError(Exception):
    """Any error of the store."""


def _kinds(**docs: str) -> None:
    for name, doc in docs.items():
        globals()[name] = type(name, (StoreError,), {"__doc__": doc, "__module__": __name__})


_kinds(
    ValueLogSize="A value is larger than a value log file may be.",
    KeyNotFound="No visible version of the key.",
    TxnTooBig="More entries or bytes than one batch may hold.",
    Conflict="A key that was read has been committed by another transaction since.",
    ReadOnlyTxn="A write in a read-only transaction.",
    DiscardedTxn="A transaction that was already committed or discarded.",
    EmptyKey="Keys have at least one byte.",
    InvalidKey="The key starts with the reserved prefix or is too long.",
    BannedKey="The key lies in a banned namespace.",
    ThresholdZero="The value threshold must be positive.",
    InvalidEncryptionKey="Keys have 16 or 32 bytes.",
    EncryptionKeyMismatch="The keyring was written with another key.",
    InvalidDataKeyID="No data key has this id.",
    StoreClosed="The store is closed.",
    TruncateNeeded="A log ends in a broken batch and the store is read-only.",
    BlockedWrites="Writes are blocked for now.",
    FillTables="No tables to compact could be chosen.",
    BadIgnoreRange="A list of ignored bytes can't be read.",
    BadChecksum="Bytes don't match their checksum.",
    BadConfig="A setting is out of its range.",
    StoreLocked="Another process holds the store.",
    ManifestError="The manifest contradicts itself or the files.",
)
