"""Row types of the delivery state."""

from __future__ import annotations

DELIVERY = "id string, event_id string, subscriber_id string, url string, partition int, sequence bigint, payload binary, event_type string, secret binary, status string, attempt int, next_attempt_at timestamp, last_error string, owner string, generation bigint, claimed_at timestamp, created_at timestamp"
SUBSCRIBER = "subscriber_id string, suspended boolean, gap boolean, dropped int, marker string"
COUNTER = "subscriber_id string, next_seq bigint"
OWNER = "partition int, owner_node string, generation bigint, state string, next_owner string"

PENDING, IN_FLIGHT, DELIVERED, DEAD, RETAINED = "pending", "in_flight", "delivered", "dead_lettered", "retained"
UNFINISHED = (PENDING, IN_FLIGHT)
ACTIVE, DRAINING = "active", "draining"
SUCCESS, RETRYABLE, PERMANENT = "success", "retryable", "permanent"
