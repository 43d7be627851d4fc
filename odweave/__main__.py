"""python -m odweave"""

from odweave.support.cli import main

main()
