"""Relational operators over records, descriptors, key rows and assignments.

records     (record_id, entity_type, perspective, uid)
descriptors (record_id, attr, value, start_ts, end_ts)
key_rows    (record_id, key_name, entity_type, key_values, start_ts, end_ts)
assignments (record_id, cluster_id), cluster_id being the smallest record_id
"""
