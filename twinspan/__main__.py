import sys

from twinspan.cli import main

sys.exit(main())
