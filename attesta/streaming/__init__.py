"""The ledger's once-only and latest-wins rules on a stream of run events."""
