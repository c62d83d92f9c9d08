"""Tables, snapshots and pages in; upserts, appends and reports out."""
