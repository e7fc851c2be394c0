"""Set-oriented planning, checking and carrying out of image renditions on Spark."""
