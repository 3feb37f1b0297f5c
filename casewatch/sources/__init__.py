"""Reading and writing: report tables, lookups, feature files, model specs."""

from casewatch.sources.binding import (
    FIRST_SOURCE, ONSET_SOURCE, PORTABLE_SOURCE, SECOND_SOURCE, Logical, bind_columns,
)
from casewatch.sources.files import (
    buckets_for, profile, read_features, read_reports, replace, write_by_case, write_features, write_table,
)
from casewatch.sources.locks import LockMismatch, lock_id, locked_spec, read_lock, write_lock
from casewatch.sources.lookups import (
    keep_classes, lookup_from_dict, read_lookup,
)
from casewatch.sources.specs import (
    ModelSpec, read_spec, spec_from_frame, write_manifest, write_spec,
)
