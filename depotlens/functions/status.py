"""Status vocabulary of deliveries and shipments."""

# Stored status texts the reports look for.
COMPLETED_ON_TIME = "Completed on time"
COMPLETED_LATE = "Completed with a delay"
