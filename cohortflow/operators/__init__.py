"""DataFrame operators over ordered groups and intervals."""
