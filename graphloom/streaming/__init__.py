"""The engine has no streaming sources or state: all of its inputs are finite edge lists."""
