"""Writers for packets, detections and reports."""
